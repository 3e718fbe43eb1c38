"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed features: words, words cut to a stem of four characters, pairs of neighbours (2-grams) and
pairs with one word between (skip-grams). Each coordinate has
its own learning rate; L1 leaves most weights at zero, so the model is a short list that is broadcast to the scoring tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import free_name, read, text_of

_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class ToxicityModel:
    """Non-zero weights by feature, and the bias. At most 2**bits entries, so its size is bounded by a parameter."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, dtype=np.float32)
        out[self.index] = self.weight
        return out


class Features:
    """Hashed features of UTF-8 texts. Words are split at ASCII white space, lower-cased (A-Z) and stripped of marks."""

    def __init__(self, bits: int, remembered: int = 500_000):
        self.shift, self.seen, self.remembered = np.uint64(64 - bits), {}, remembered

    def __call__(self, text: bytes, block: int = 200_000) -> np.ndarray:
        """Distinct features of the whole text, in blocks so that very long texts need bounded memory."""
        words = [w for w in (w.strip(b".,;:!?\"'()[]{}") for w in text.lower().split()) if w]
        parts = [self._block(words[max(0, k - 2) : k + block]) for k in range(0, len(words), block)]
        return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.empty(0, dtype=np.int32)

    def _stems(self, words: list[bytes]) -> np.ndarray:
        """Unigrams of the words cut to their first four characters, for inflected forms that were never seen."""
        stems = {w.decode("utf-8", "replace")[:4] for w in set(words) if len(w) > 4}
        return np.fromiter((xxhash.xxh64_intdigest(s, 11) for s in stems), dtype=np.uint64, count=len(stems))

    def _block(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.remembered:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w, 7)
        h = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
        pairs = (h[:-1] * _PAIR) ^ (h[1:] + _SKIP)
        skips = (h[:-2] * _SKIP) ^ (h[2:] + _PAIR)
        every = np.concatenate([h, self._stems(words), pairs * _SKIP, skips * _PAIR])
        return np.unique((every * _PAIR) >> self.shift).astype(np.int32)


class Scorer:
    """Probability of label 1 of UTF-8 texts."""

    def __init__(self, model: ToxicityModel):
        self.make, self.weights, self.bias = Features(model.bits), model.dense(), model.bias

    def __call__(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.bias + float(self.weights[self.make(text)].sum())))))


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> ToxicityModel:
    """FTRL-proximal over (features, label) rows in the given order.

    The bias is a coordinate of its own without L1. Without rows the bias is -5; it starts at the smoothed log odds.
    """
    z, n, live = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    positive = sum(y for _, y in rows)
    bias, bias_n = (math.log((positive + 0.5) / (len(rows) - positive + 0.5)) if rows else -5.0), 0.0
    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + np.sqrt(nx)) / alpha + l2))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(w.sum())))))
            g = p - y
            grown = np.sqrt(nx + g * g) - np.sqrt(nx)
            z[x] = zx + g - grown / alpha * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + math.sqrt(bias_n))
    live = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    index = np.flatnonzero(live).astype(np.int32)
    return ToxicityModel(bits, index, live[index].astype(np.float32), bias)


def fit_toxicity(documents: DataFrame, labels: DataFrame, bits: int = 20, most_rows: int = 16_000, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1) -> ToxicityModel:
    """Model learnt from ``labels`` (doc_id, toxic) of ``documents`` (doc_id, text).

    Learns from ``most_rows`` labelled documents at most, those with the smallest digests of doc_id: a bound on the
    learning task, whatever the corpus. A document with several labels is toxic if one says so; null labels and ids are
    ignored. Of rows that share a doc_id one text counts, that with the least features in byte order. Null texts count as
    empty. Without labelled documents the model is a bias alone. Texts are turned to features on the executors, then one
    task learns from the bounded set.
    """
    truth = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    # A cut by digest leaves a few more rows than are wanted, so that the ordered limit never sees the whole table.
    share = min(1.0, (1.2 * most_rows + 1000) / max(1, truth.count()))
    digest = F.md5(F.col("doc_id").cast("string"))
    drawn = truth.filter(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") <= int(share * (1 << 32)))
    chosen = drawn.orderBy(digest, "doc_id").limit(most_rows)
    texts = documents.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    # The chosen ids are bounded by most_rows, so their broadcast is too.
    rows = texts.join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(bits)
        for batch in batches:
            found = [make(t).tobytes() for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(found, pa.binary())], names=["doc_id", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            for doc_id, y, x in zip(batch["doc_id"].to_pylist(), batch["label"].to_pylist(), batch["features"].to_pylist(), strict=True):
                if doc_id != last:  # repeated rows of a document count once
                    rows.append((np.frombuffer(x, dtype=np.int32), int(y > 0)))
                last = doc_id
        model = ftrl(rows, bits, alpha, beta, l1, l2, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([model.index.tobytes()], pa.binary()), pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], names=["index", "weight", "bias"])

    digested = rows.mapInArrow(features, "doc_id long, label int, features binary")
    ordered = digested.withColumn("order", F.md5(F.col("doc_id").cast("string"))).repartition(1).sortWithinPartitions("order", "doc_id", "features").drop("order")
    found = ordered.mapInArrow(learn, "index binary, weight binary, bias double").first()
    if found is None:
        return ftrl([], bits, alpha, beta, l1, l2, epochs)
    return ToxicityModel(bits, np.frombuffer(found["index"], dtype=np.int32), np.frombuffer(found["weight"], dtype=np.float32), found["bias"])


def score_toxicity(documents: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """(doc_id, score, *keep) for each row: the probability of label 1. Null texts count as empty and score by the bias."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([of(t) for t in batch["text"].cast(pa.binary()).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(score, "doc_id long, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnt_model(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The production model: learns only from labelled rows whose crc32(doc_id) mod 4 is not 2."""
    return fit_toxicity(documents, labels.filter(~held_out()))


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``documents`` without those that score ``threshold`` or more; columns unchanged, whatever their names.

    Each row is judged by its own text, with or without a doc_id, and passes or not where it is: no shuffle. Null and empty
    texts score by the bias. Repeated rows share their fate. An empty table gives an empty result.
    """
    sent = documents.sparkSession.sparkContext.broadcast(learnt_model(documents, labels))
    judged = free_name(documents, "judged")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            kept = pa.array([score(t) < threshold for t in batch[judged].cast(pa.binary()).to_pylist()], pa.bool_())
            yield batch.drop_columns([judged]).filter(kept)

    return documents.withColumn(judged, text_of()).mapInArrow(clean, documents.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = score_toxicity(documents, learnt_model(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
