"""Deduplication that keeps the first row, by aggregation with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import MAX_LENGTH, normalize_text
from textloom.operators.key_filter import anti_join


def first_per(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in the order of ``order``. Rows are keyed by a digest, so long keys aren't shuffled twice."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.sha2(key, 256).alias("_key")).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def dedupe_exact(rows: DataFrame, text: str, *order: str) -> DataFrame:
    return first_per(rows, F.coalesce(F.col(text), F.lit("")), *order)


def dedupe_normalized(rows: DataFrame, text: str, *order: str, compatibility: bool = True, most: int | None = MAX_LENGTH) -> DataFrame:
    """The first row of each normalized text. Messages are compared by their first ``most`` code points; None compares whole texts."""
    return first_per(rows, normalize_text(F.col(text), compatibility=compatibility, most=most), *order)


def dedupe_two_stage(rows: DataFrame, text: str, *order: str, compatibility: bool = True, most: int | None = MAX_LENGTH) -> DataFrame:
    """Exact, then normalized: equal texts are equal when normalized, so one shuffle gives the survivors of both."""
    return dedupe_normalized(rows, text, *order, compatibility=compatibility, most=most)


def dedupe_counts(rows: DataFrame, text: str, compatibility: bool = True) -> DataFrame:
    """(n_rows, removed_exact, removed_normalized) of the two stages."""
    normal = rows.groupBy(F.sha2(normalize_text(F.col(text), compatibility=compatibility), 256).alias("k"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("e")).agg(F.count("*").alias("n"))
    per_key = normal.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("e"))
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"), F.count("*").alias("k"))
    return total.select(F.col("n").alias("n_rows"), (F.col("n") - F.col("e")).alias("removed_exact"), (F.col("e") - F.col("k")).alias("removed_normalized"))


def last_per_id(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each id."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def drop_eval_overlap(evaluation: DataFrame, train: DataFrame, text: str = "text", key: str = "id", **options) -> DataFrame:
    """Evaluation rows whose text and id both are not in train: two anti joins in place of one with OR.

    A filter over the keys of ``train`` goes before each (``options`` as in ``KeyFilter.build``), so of the evaluation rows only
    those that may be there are shuffled. Texts meet by their digests. A null id or text is in nothing.
    """
    held = free_name(evaluation, "_text")
    digest = F.sha2(F.col(text), 256).alias(held)
    left = anti_join(evaluation, train.select(key).filter(F.col(key).isNotNull()), [key], **options)
    return anti_join(left.withColumn(held, digest), train.select(digest).filter(F.col(held).isNotNull()), [held], **options).drop(held)


def free_name(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``rows`` doesn't have."""
    while name in {c.lower() for c in rows.columns}:
        name = "_" + name
    return name
