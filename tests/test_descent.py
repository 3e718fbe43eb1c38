"""Full-batch descent against plain numpy on dense rows."""

import numpy as np
import pytest

from textloom.operators import candidates, descent
from textloom.operators.descent import predict_descent, saved_rounds, sparse_rows, train_descent
from textloom.plans.message_queries import vocabulary
from textloom.plans.views import view
from textloom.schema import LABELS


def plain(x, y, classes, rounds, rate=0.1, seed=42):
    w, b, target = np.random.default_rng(seed).normal(0, 0.01, size=(x.shape[1], classes)), np.zeros(classes), np.eye(classes)[y]
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) / len(x)
        w, b = w - rate * x.T @ g, b - rate * g.sum(axis=0)
    return np.vstack([w, b])


@pytest.fixture(scope="module")
def labelled(spark):
    rows = view(spark, "/root/testdata/sf0.001", "labelled").filter("label <> 'NEEDS_REVIEW'")
    words = vocabulary(rows)
    return candidates.ngram_table(rows, words), words.count()


def dense(table, size):
    rows = table.collect()
    return np.array([r["features"].toArray() for r in rows]), np.array([int(r["label_index"]) for r in rows]), [r["id"] for r in rows]


@pytest.mark.parametrize("at_once", [64, 2])
def test_weights_equal_plain_numpy(spark, labelled, tmp_path, monkeypatch, at_once):
    table, size = labelled
    monkeypatch.setattr(descent, "AT_ONCE", at_once)  # 2: sums of sums
    x, y, ids = dense(table, size)
    got = train_descent(sparse_rows(table.repartition(5)), size, len(LABELS), rounds=12, state=str(tmp_path / "s"), save_every=5)
    wanted = plain(x, y, len(LABELS), 12)
    assert np.abs(got - wanted).max() < 1e-9 and saved_rounds(spark, str(tmp_path / "s")) == [5, 10]
    found = {r["id"]: r["class_index"] for r in predict_descent(table, got, "id").collect()}
    assert found == dict(zip(ids, (x @ wanted[:-1] + wanted[-1]).argmax(axis=1).tolist(), strict=True))


def test_a_run_goes_on_from_the_last_saved_round(spark, labelled, tmp_path, monkeypatch):
    table, size = labelled
    rows, state = sparse_rows(table.limit(60).coalesce(2)).persist(), str(tmp_path / "s")
    whole = train_descent(rows, size, len(LABELS), rounds=6)
    made, total = [], descent.total_gradient

    def breaks(*a):
        made.append(1)
        if len(made) == 4:
            raise RuntimeError("lost")
        return total(*a)

    monkeypatch.setattr(descent, "total_gradient", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        train_descent(rows, size, len(LABELS), rounds=6, state=state, save_every=2)
    assert saved_rounds(spark, state) == [2]
    again = train_descent(rows, size, len(LABELS), rounds=6, state=state, save_every=2)
    assert np.abs(again - whole).max() < 1e-9 and len(made) == 8


def test_odd_rows(spark):
    rows = spark.createDataFrame([([], [], 0), ([1], [2.0], 1), ([], [], 1)], "at array<int>, value array<double>, label int")
    got = train_descent(rows, 3, 2, rounds=3)
    assert np.abs(got - plain(np.array([[0, 0, 0], [0, 2.0, 0], [0, 0, 0]]), np.array([0, 1, 1]), 2, 3)).max() < 1e-12
    assert train_descent(rows.limit(0), 3, 2, rounds=3).shape == (4, 2)


def test_blocks_hold_rows_exactly_and_in_less_room(spark, monkeypatch):
    rows = [(list(range(k % 7)), [float(j % 3) for j in range(k % 7)], k % 4) for k in range(50)] + [([70_000], [0.1], 1), ([], [], 0), ([3], [-2.0], 2)]
    monkeypatch.setattr(descent, "BLOCK", 8)
    table = spark.createDataFrame(rows, "at array<int>, value array<double>, label int").coalesce(1)
    got = []
    for batch in descent.blocks(table).toArrow().to_batches():
        for row, at, value, label in descent._unpacked(batch):
            got += [(at[row == k].tolist(), value[row == k].tolist(), int(label[k])) for k in range(len(label))]
    assert got == rows
    small = descent.blocks(table.limit(48)).collect()
    assert all(r.types[1:] == ["|u1", "|u1", "|u1"] for r in small) and sum(r.rows for r in small) == 48


def test_what_the_rows_of_a_run_share_is_held_once(spark, monkeypatch):
    monkeypatch.setattr(descent, "BLOCK", 16)
    monkeypatch.setattr(descent, "RUN", 8)
    rows = [([*range(20), 20 + k], [*map(float, range(1, 20)), float(1 + k % 2), 1.5], k % 3, 1 + k % 4) for k in range(42)]
    table = spark.createDataFrame(rows, "at array<int>, value array<double>, label int, times long").coalesce(1)
    batches, got, entries = descent.blocks(table).toArrow().to_batches(), [], 0
    for batch in batches:
        for row, at, value, label in descent._unpacked(batch):
            got += [(at[row == k].tolist(), value[row == k].tolist(), int(label[k])) for k in range(len(label))]
        entries += sum(len(part[0]) for part in descent._parts(batch))
    assert got == [r[:3] for r in rows] and sum(sum(b["rows"].to_pylist()) for b in batches) == sum(r[3] for r in rows)
    assert entries == 42 * 2 + 6 * 19  # 42 * 21 in all
    x, y = np.zeros((42, 62)), np.array([r[2] for r in rows])
    for k, (at, value, *_) in enumerate(rows):
        x[k, at] = value
    often = np.repeat(np.arange(42), [r[3] for r in rows])
    assert np.abs(descent.train_descent(table, 62, 3, rounds=5) - plain(x[often], y[often], 3, 5)).max() < 1e-12
    # Places that repeat or don't ascend come back as they were.
    odd = spark.createDataFrame([([5, 3, 3], [1.0, 1.0, 1.0], 0), ([5], [1.0], 1)] * 4, "at array<int>, value array<double>, label int").coalesce(1)
    back = [(at[row == k].tolist(), int(label[k])) for batch in descent.blocks(odd).toArrow().to_batches() for row, at, _, label in descent._unpacked(batch) for k in range(len(label))]
    assert back == [([5, 3, 3], 0), ([5], 1)] * 4
