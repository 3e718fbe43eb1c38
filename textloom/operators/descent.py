"""Multinomial logistic regression by full-batch gradient descent over sparse rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.places import names_in, shared_folder

#: More partial gradients than this are added up on the executors before the driver gets them.
AT_ONCE = 64


def sparse_rows(table: DataFrame, features: str = "features", label: str = "label_index", times: str | None = None) -> DataFrame:
    """(at, value, label, times): the places and values of each row's sparse vector, its label's number, and how often it counts."""
    vector = F.unwrap_udt(features)
    return table.select(vector["indices"].alias("at"), vector["values"].alias("value"), F.col(label).cast("int").alias("label"), (F.col(times) if times else F.lit(1)).cast("long").alias("times"))


#: Rows of one block, and of one run, whose rows hold what all of them share once.
BLOCK, RUN = 16384, 256


def _smallest(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them all exactly."""
    for kind in (np.uint8, np.uint16, np.int32):
        if not len(numbers) or (numbers.min() >= np.iinfo(kind).min and numbers.max() <= np.iinfo(kind).max and (numbers == numbers.astype(kind)).all()):
            return numbers.astype(kind)
    return numbers


def _shared(row: np.ndarray, at: np.ndarray, value: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which entries all rows of their run have, ``runs`` rows each; and these entries once for a run, as (run, place, value).

    In rows whose places don't ascend nothing is shared.
    """
    none = np.zeros(len(at), dtype=bool), *(np.empty(0, dtype=x) for x in (np.int64, at.dtype, value.dtype))
    if not len(at) or ((np.diff(at) <= 0) & (np.diff(row) == 0)).any():
        return none
    kinds, kind = np.unique(value, return_inverse=True)
    run, width = np.repeat(np.arange(len(runs)), runs), int(at.max()) + 1
    key, entry, count = np.unique((run[row] * width + at) * len(kinds) + kind, return_inverse=True, return_counts=True)
    whole = count == runs[key // (width * len(kinds))]
    held = key[whole]
    return whole[entry], held // (width * len(kinds)), (held // len(kinds) % width).astype(at.dtype), kinds[held % len(kinds)]


def blocks(rows: DataFrame) -> DataFrame:
    """``rows`` as (rows, types, arrays, ...): some thousands of rows each as arrays in the smallest types, since rounds read them again and again.

    Counts and places of a bounded vocabulary take three bytes an entry in place of twelve, and a round unpacks no row. What
    all rows of a run have is held once for the run, so a round does less if rows that are alike come one after the other.
    """
    counted = "times" in rows.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), BLOCK):
                batch = whole.slice(first, BLOCK)
                n, (row, at, value) = len(batch), _flat(batch)
                runs = np.diff(np.append(np.arange(0, n, RUN), n))
                times = batch["times"].to_numpy() if counted else np.ones(n, dtype=np.int64)
                common, run, common_at, common_value = _shared(row, at, value, runs)
                own = [np.bincount(row[~common], minlength=n), at[~common], value[~common], batch["label"].to_numpy()]
                both = [[_smallest(a) for a in own], [_smallest(a) for a in (times, runs, np.bincount(run, minlength=len(runs)), common_at, common_value)]]
                columns = [x for small in both for x in (pa.array([[a.dtype.str for a in small]]), pa.array([[a.tobytes() for a in small]], pa.list_(pa.binary())))]
                yield pa.RecordBatch.from_arrays([pa.array([int(times.sum())]), *columns], names=["rows", "types", "arrays", "shared_types", "shared_arrays"])

    return rows.mapInArrow(packed, "rows long, types array<string>, arrays array<binary>, shared_types array<string>, shared_arrays array<binary>")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place, value, label, times, runs) of each block of a batch; row len(label) + k has what the rows of run k share."""
    for arrays in zip(*(batch[n].to_pylist() for n in ("types", "arrays", "shared_types", "shared_arrays")), strict=True):
        own, common = ([np.frombuffer(a, dtype=t) for a, t in zip(arrays[k + 1], arrays[k], strict=True)] for k in (0, 2))
        sizes, (times, runs) = np.concatenate([own[0], common[2]]), common[:2]
        at, value = np.concatenate([own[1], common[3]], dtype=np.int64), np.concatenate([own[2], common[4]], dtype=np.float64)
        yield np.repeat(np.arange(len(sizes)), sizes), at, value, own[3].astype(np.int64), times.astype(np.int64), runs.astype(np.int64)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place, value, label) of each block of a batch, every row with all that it has."""
    for row, at, value, label, _, runs in _parts(batch):
        n = len(label)
        own, first = row < n, np.cumsum(runs) - runs
        run = row[~own] - n
        every = np.repeat(first[run] - np.cumsum(runs[run]) + runs[run], runs[run]) + np.arange(runs[run].sum())  # the rows of a run, for each of its entries
        row, at, value = (np.concatenate(x) for x in ((row[own], every), (at[own], np.repeat(at[~own], runs[run])), (value[own], np.repeat(value[~own], runs[run]))))
        order = np.lexsort((at, row)) if len(every) else slice(None)
        yield row[order], at[order], value[order], label


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of each entry of a batch."""
    at, value = batch["at"], batch["value"]
    sizes = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(len(batch)), sizes), at.flatten().to_numpy(), value.flatten().to_numpy()


def products(row: np.ndarray, at: np.ndarray, value: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    """(class, row): what the entries of each of ``rows`` rows score, without the bias."""
    ones = (value == 1).all()
    return np.stack([np.bincount(row, weights=w[at] if ones else w[at] * value, minlength=rows) for w in np.ascontiguousarray(weights.T)])


def logits(row: np.ndarray, at: np.ndarray, value: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    """Scores of ``rows`` rows; the last row of ``weights`` is the bias."""
    return products(row, at, value, rows, weights).T + weights[-1]


def gradient(row: np.ndarray, at: np.ndarray, value: np.ndarray, label: np.ndarray, times: np.ndarray, runs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over rows, each ``times``, of the gradient of the log loss; row len(label) + k has what the rows of run k share."""
    n, run = len(label), np.repeat(np.arange(len(runs)), runs)
    z = products(row, at, value, n + len(runs), weights)
    z = z[:, :n] + z[:, n:][:, run] + weights[-1][:, None]
    p = np.exp(z - z.max(axis=0))
    p /= p.sum(axis=0)
    p[label, np.arange(n)] -= 1
    p *= times
    both = np.concatenate([p, np.add.reduceat(p, np.cumsum(runs) - runs, axis=1)], axis=1)
    size, ones = len(weights) - 1, (value == 1).all()
    return np.vstack([np.stack([np.bincount(at, weights=x[row] if ones else x[row] * value, minlength=size) for x in both], axis=1), p.sum(axis=1)])


def total_gradient(rows: DataFrame, weights: np.ndarray, partitions: int) -> np.ndarray:
    """The gradient over all ``rows``, in ``blocks``: one partial sum a partition; of many, sums of sums on the executors first."""
    spark, shape = rows.sparkSession, weights.shape
    shared = spark.sparkContext.broadcast(weights)  # as large as the vocabulary, whatever the rows

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for block in _parts(batch):
                total += gradient(*block, shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sum"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for one in batch["sum"].to_pylist():
                total += np.frombuffer(one).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sum"])

    sums = rows.mapInArrow(part, "sum binary")
    while partitions > AT_ONCE:
        partitions = -(-partitions // AT_ONCE)
        sums = sums.repartition(partitions).mapInArrow(added, "sum binary")
    total = np.sum([np.frombuffer(r["sum"]).reshape(shape) for r in sums.collect()], axis=0)
    shared.unpersist()
    return total


def saved_rounds(spark: SparkSession, state: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in names_in(spark, state) if n.startswith("round=") and "_SUCCESS" in names_in(spark, f"{state}/{n}"))


def train_descent(rows: DataFrame, size: int, classes: int, rounds: int = 200, rate: float = 0.1, seed: int = 42, state: str | None = None, save_every: int = 50) -> np.ndarray:
    """Weights (size + 1, classes), the bias last, after ``rounds`` steps of the mean gradient over ``rows`` (at, value, label, maybe times).

    They start from a normal distribution of deviation 0.01, biases from 0. The rows are written once, in ``blocks``, and read each
    round; a row that counts several ``times`` is gone over once. What goes out and comes back in a round is as large as the vocabulary. Every ``save_every`` rounds the weights are written
    to the folder ``state``; a run that finds some there goes on from the last. Without rows the start is returned.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "descent")
    packed = blocks(rows)
    packed.write.parquet(folder)
    table = spark.read.schema(packed.schema).parquet(folder)
    table = table.persist()
    n, partitions = table.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], table.select(F.spark_partition_id().alias("p")).distinct().count()
    weights = np.vstack([np.random.default_rng(seed).normal(0, 0.01, size=(size, classes)), np.zeros((1, classes))])
    state = state or shared_folder(spark, "descent-state")
    done = saved_rounds(spark, state)
    if done:
        weights = np.array(spark.read.parquet(f"{state}/round={done[-1]}").first()["weights"]).reshape(weights.shape)
    for k in range(done[-1] if done else 0, rounds if n else 0):
        weights = weights - rate * total_gradient(table, weights, partitions) / n
        if (k + 1) % save_every == 0:
            spark.createDataFrame([(weights.ravel().tolist(),)], "weights array<double>").coalesce(1).write.mode("overwrite").parquet(f"{state}/round={k + 1}")
    table.unpersist()
    return weights


def predict_descent(table: DataFrame, weights: np.ndarray, key: str, features: str = "features") -> DataFrame:
    """(key, class_index): the first class with the highest score."""
    shared = table.sparkSession.sparkContext.broadcast(weights)
    vector = F.unwrap_udt(features)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = logits(*_flat(batch), len(batch), shared.value).argmax(axis=1) if len(batch) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(found.astype(np.int32))], names=[key, "class_index"])

    rows = table.select(key, vector["indices"].alias("at"), vector["values"].alias("value"))
    return rows.mapInArrow(best, f"{key} {table.schema[key].dataType.simpleString()}, class_index int")
