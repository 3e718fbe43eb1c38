"""The versioned table and the stream intake on it, with a failure planted at each step."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from textloom.places import create_once, names_in, read_text
from textloom.sources import versions
from textloom.sources.versions import CommitConflict, VersionedTable, latest_unique
from textloom.streaming import intake

SCHEMA = "uri long, key string, action string, at long"


def one_by_one(rows):
    """Insert-or-replace with two unique columns, as a database does it."""
    held = []
    for row in rows:
        held = [h for h in held if h[0] != row[0] and (h[1] is None or h[1] != row[1])] + [row]
    return sorted(held, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_a_row_replaces_all_that_share_a_unique_value(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.choice([None, *"abcdefghijklmnop"]), rng.choice("xyz"), at) for at in range(200)]
    assert found(latest_unique(spark.createDataFrame(rows, SCHEMA), [["uri"], ["key"]], ["at"])) == one_by_one(rows)
    # Replaced itself, a row has replaced others before.
    chain = [(1, "a", "x", 1), (2, "a", "x", 2), (2, "b", "x", 3)]
    assert found(latest_unique(spark.createDataFrame(chain, SCHEMA), [["uri"], ["key"]], ["at"])) == [(2, "b", "x", 3)]
    tied = [(1, "a", "x", 1), (1, "a", "x", 1), (1, "a", "x", None)]
    assert found(latest_unique(spark.createDataFrame(tied, SCHEMA), [["uri"], ["key"]], ["at"])) == [(1, "a", "x", 1)]


def test_upserts_equal_inserts_one_by_one(spark, tmp_path):
    rng, said = random.Random(5), []
    table = VersionedTable(spark, str(tmp_path / "t"), [["uri"], ["key"]], buckets=4)
    assert table.read() is None and table.versions() == []
    for step in range(5):
        rows = [(rng.randrange(30), rng.choice([None, *"abcdefgh"]), f"s{step}", step * 100 + k) for k in range(12)]
        said += rows
        after = table.upsert(spark.createDataFrame(rows, SCHEMA), "at", ("w", step))
        assert after.version == step + 1 and found(table.read()) == one_by_one(said)
    assert found(table.read(table.snapshot(1))) == one_by_one(said[:12])
    # A batch that is known changes nothing, a version and its files stay as they are.
    assert table.upsert(spark.createDataFrame([(1, None, "again", 0)], SCHEMA), "at", ("w", 4)).version == 5
    gone = table.forget(keep=1)
    assert gone and table.versions() == [5] and found(table.read()) == one_by_one(said) and table.forget(keep=1) == []
    assert table.upsert(spark.createDataFrame([], SCHEMA), "at").version == 6 and found(table.read()) == one_by_one(said)


def test_only_buckets_with_replaced_rows_are_written_again(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), [["uri"]], buckets=8)
    first = table.upsert(spark.range(100).selectExpr("id AS uri", "'a' AS key", "'x' AS action", "0L AS at"), "at")
    second = table.upsert(spark.range(100, 200).selectExpr("id AS uri", "'a' AS key", "'x' AS action", "0L AS at"), "at")
    assert all(second.folders[b][0] == f[0] and len(second.folders[b]) == 2 for b, f in first.folders.items())
    third = table.upsert(spark.createDataFrame([(7, "a", "y", 1)], SCHEMA), "at")
    changed = [b for b in third.folders if third.folders[b] != second.folders[b]]
    assert len(changed) == 1 and len(third.folders[changed[0]]) == 1
    assert table.read().count() == 200 and table.read().filter("action = 'y'").count() == 1


def test_many_folders_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MOST_FOLDERS", 3)
    table = VersionedTable(spark, str(tmp_path / "t"), [["uri"]], buckets=1)
    for k in range(5):
        after = table.upsert(spark.createDataFrame([(k, None, "x", k)], SCHEMA), "at")
        assert len(after.folders["0"]) <= 3
    assert table.read().count() == 5


def test_one_of_two_writers_wins_and_the_other_runs_again(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), [["uri"]], buckets=2)
    other, write, raced = VersionedTable(spark, str(tmp_path / "t"), [["uri"]], buckets=2), VersionedTable._write, []

    def slow(self, rows):
        out = write(self, rows)
        if self is table and not raced:
            raced.append(other.upsert(spark.createDataFrame([(2, None, "other", 1)], SCHEMA), "at"))
        return out

    monkeypatch.setattr(VersionedTable, "_write", slow)
    assert table.upsert(spark.createDataFrame([(1, None, "mine", 1)], SCHEMA), "at").version == 2
    assert found(table.read()) == [(1, None, "mine", 1), (2, None, "other", 1)]
    raced.clear()
    with pytest.raises(CommitConflict):
        table.upsert(spark.createDataFrame([(3, None, "mine", 1)], SCHEMA), "at", attempts=1)
    assert found(table.read()) == [(1, None, "mine", 1), (2, None, "other", 1)]


def test_a_file_is_made_once(spark, tmp_path):
    path = str(tmp_path / "a" / "b.json")
    assert create_once(spark, path, "é1") and not create_once(spark, path, "2")
    assert read_text(spark, path) == "é1" and [n for n in names_in(spark, str(tmp_path / "a")) if not n.endswith("crc")] == ["b.json"]
    assert names_in(spark, str(tmp_path / "none")) == []


def deliveries(spark, n=200):
    rows = [(f"m{i}", f"sender{i % 7}", f"2024-01-01 00:{i % 60:02d}:00", f"Your OTP: {1000 + i}" if i % 2 else "hello", None) for i in range(n)]
    return spark.createDataFrame(rows, "message_ref string, address string, ts string, body string, subscription string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    frame = deliveries(spark, 40)
    frame.unionByName(frame.limit(10)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    for attempt, held in (("a", 40), ("a", 40), ("b", 80)):
        intake.stream_classify(stream, raw, store, str(tmp_path / f"checkpoint-{attempt}")).awaitTermination()
        assert intake.raw_messages(spark, raw).count() == held  # a new checkpoint takes everything in again
    batch = {(r.message_ref, r.action) for r in intake.classify_messages(frame).select("message_ref", "action").collect()}
    assert {(r.message_ref, r.action) for r in intake.result_store(spark, store).read().collect()} == batch


class Broken(Exception):
    pass


STEPS = ["raw begun", "raw half", "raw written", "data written", "committed"]


@pytest.mark.parametrize("step", STEPS)
def test_a_failure_at_any_step_and_a_repeat_lose_nothing(spark, tmp_path, monkeypatch, step):
    """Batch 0 is whole; batch 1 fails at ``step`` and is repeated. It brings 100 known deliveries and 200 new ones."""
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    everything = intake.with_deliver_key(deliveries(spark, 300))
    first, second = everything.filter("CAST(substr(message_ref, 2) AS INT) < 100"), everything
    intake.store_batch(raw, store)(first, 0)
    whole = intake.result_store(spark, store).read().count()
    assert whole == 100
    folder = tmp_path / "raw" / "_writer=intake" / "_batch=1"
    with monkeypatch.context() as m:
        if step == "raw begun":
            folder.mkdir(parents=True)
        elif step == "raw half":
            second.limit(86).write.parquet(str(folder))
            (folder / "_SUCCESS").unlink()
        else:
            if step == "raw written":
                m.setattr(intake, "classify_messages", lambda rows: (_ for _ in ()).throw(Broken))
            elif step == "data written":
                m.setattr(versions, "create_once", lambda *a: (_ for _ in ()).throw(Broken))
            else:
                commit = VersionedTable._commit

                def fail_after(*a):
                    commit(*a)
                    raise Broken

                m.setattr(VersionedTable, "_commit", fail_after)
            with pytest.raises(Broken):
                intake.store_batch(raw, store)(second, 1)
        # Readers see all of batch 1 or nothing.
        assert intake.result_store(spark, store).read().count() == (300 if step == "committed" else 100)
    for _ in range(2):
        intake.store_batch(raw, store)(second, 1)
        held = intake.raw_messages(spark, raw)
        assert held.groupBy("_batch").count().orderBy("_batch").collect() == [(0, 100), (1, 300)]
        rows = intake.result_store(spark, store).read()
        assert rows.count() == 300 and rows.select("deliver_key").distinct().count() == 300 and rows.select("message_ref").distinct().count() == 300


def test_a_store_that_was_removed_is_built_from_the_raw_batch(spark, tmp_path):
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    batch = intake.with_deliver_key(deliveries(spark))
    intake.store_batch(raw, store)(batch, 0)
    shutil.rmtree(store)
    intake.store_batch(raw, store)(batch.limit(0), 0)  # whatever the repeat brings, the stored batch counts
    assert intake.raw_messages(spark, raw).count() == 200 and intake.result_store(spark, store).read().count() == 200


def test_what_changes_are_made_of_runs_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    table = VersionedTable(spark, str(tmp_path / "t"), [["a"], ["b"]], buckets=4)
    for step in range(3):
        changes = spark.range(20).selectExpr(f"id + {5 * step} AS a", "concat('b', id % 15) AS b", f"{step} AS step", "id AS place")
        table.upsert(changes.mapInArrow(counted, changes.schema), "place", ("w", step))
        assert made.value == 20 * (step + 1)
    assert names_in(spark, f"{tmp_path}/t/staged") == [] and table.read().count() == 15
    table.upsert(changes.mapInArrow(counted, changes.schema), "place", ("w", 2))
    assert made.value == 60
