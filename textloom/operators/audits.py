"""Audits of labelled packs: distributions, contradictions, transitions. Each is one aggregate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.schema import LABELS, NEEDS_REVIEW


def distribution(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def flags(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``flags``: names of the checks that hold, computed once a row."""
    return rows.withColumn("flags", F.array_compact(F.array(*(F.when(c, n) for n, c in checks.items()))))


def each_flag(flagged: DataFrame, *keep: str) -> DataFrame:
    """A row for each flag. The outer form keeps the optimizer from a filter on ``flags``, which would repeat every check in it."""
    return flagged.select(*keep, F.explode_outer("flags").alias("flag")).filter("flag IS NOT NULL")


def flag_counts(flagged: DataFrame, *by: str) -> DataFrame:
    return each_flag(flagged, *by).groupBy(*by, "flag").agg(F.count("*").alias("n"))


def flag_samples(flagged: DataFrame, key: str, most: int) -> DataFrame:
    """(flag, n, samples): how many rows have each flag, and the least ``most`` keys among them, joined by commas."""
    rows = each_flag(flagged, key)
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("flag").orderBy(key))).filter(F.col("_rank") <= most)
    samples = ranked.groupBy("flag").agg(F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ",").alias("samples"))
    return rows.groupBy("flag").agg(F.count("*").alias("n")).join(samples, "flag")


def verdicts(flagged: DataFrame, by: str, critical: tuple[str, ...]) -> DataFrame:
    """(by, n, critical, warnings, status): how often ``critical`` and other flags come; FAIL with a critical one, WARN with another, else PASS."""
    bad = F.size(F.array_intersect("flags", F.array(*(F.lit(c) for c in critical))))
    out = flagged.groupBy(by).agg(F.count("*").alias("n"), F.sum(bad).alias("critical"), F.sum(F.size("flags") - bad).alias("warnings"))
    return out.withColumn("status", F.when(F.col("critical") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def conflicts(rows: DataFrame, key: Column, label: str = "label") -> DataFrame:
    """(key, n, n_labels) of keys that carry more than one label. Long keys go in as digests."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.size(F.collect_set(label)).cast("long").alias("n_labels")).filter("n_labels > 1")


def pack_profile(packs: DataFrame) -> DataFrame:
    """(pack, n, one count for each label, review_share, n_fixed, n_annotators)."""
    counts = [F.count_if(F.col("label") == x).alias(x.lower()) for x in (*LABELS, NEEDS_REVIEW)]
    return packs.groupBy("pack").agg(F.count("*").alias("n"), *counts, F.avg(F.when(F.col("label") == NEEDS_REVIEW, 1.0).otherwise(0.0)).alias("review_share"), F.count_if(F.contains("notes", F.lit("[fix:"))).alias("n_fixed"), F.size(F.collect_set("annotator")).cast("long").alias("n_annotators"))


def forced_rates(packs: DataFrame, spam: Column) -> DataFrame:
    """(spam_in_review, ham_forced): share of spam left for review, and of other rows forced into a class."""
    review = F.col("label") == NEEDS_REVIEW
    return packs.agg(F.avg(F.when(spam, review.cast("double"))).alias("spam_in_review"), F.avg(F.when(~spam, (~review).cast("double"))).alias("ham_forced"))


def content_manifest(rows: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """(split, n, content_hash): a hash of each split that neither order nor partitioning changes.

    Rows are hashed, hashes sorted within the buckets of their first ``digits`` hex digits, and the buckets' hashes hashed in
    order, two digits at a time. Within a bucket equal rows count as often as they come. A bucket holds a share of
    16**-digits of the distinct rows: 4 suits up to some 10**9 rows, 6 some 10**12. The hash depends on it.
    """
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    hashed = rows.select("split", digest.alias("h"))
    counted = hashed.groupBy("split", "h").agg(F.count("*").alias("c"))
    level = counted.groupBy("split", F.substring("h", 1, digits).alias("b")).agg(F.sum("c").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", F.col("c").cast("string")))), ","), 256).alias("h"))
    for left in range(digits - 2, 0, -2):
        level = level.groupBy("split", F.substring("b", 1, left).alias("b")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "h"))), ","), 256).alias("h"))
    return level.groupBy("split").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "h"))), ","), 256).alias("content_hash"))


def queue_view(store: DataFrame, messages: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """Stored rows with one of ``actions``, newest first, with their bodies."""
    return store.filter(F.col("action").isin(*actions)).join(messages, store["message_uri"] == messages["msg_id"]).orderBy(F.desc("created_at"), "message_uri")


def inbox_view(messages: DataFrame, store: DataFrame) -> DataFrame:
    """Messages that aren't held back; a message that the store doesn't know stays."""
    held = store.filter(F.col("action").isin("SUSPECT", "REVIEW")).select("message_uri").distinct()
    return messages.join(held, messages["msg_id"] == held["message_uri"], "left_anti")


def restore_to_inbox(store: DataFrame, chosen: DataFrame) -> DataFrame:
    back = chosen.select("message_uri").distinct().withColumn("_back", F.lit(True))
    return store.join(back, "message_uri", "left").withColumn("action", F.when(F.col("_back"), "INBOX").otherwise(F.col("action"))).drop("_back")


def upsert(store: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Store after insert-or-replace: of each key the change with the highest ``order``, else the stored row."""
    both = store.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*store.columns), F.struct("_new", order)).alias("_row")).select("_row.*")
