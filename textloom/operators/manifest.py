"""Hash trees over splits, kept level by level: what two versions differ in is found from the top, and only that is hashed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def _joined(values: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(values)), ","), 256)


def leaves(rows: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """(split, digits, bucket, n, h): a hash for each bucket of rows whose digests begin alike; equal rows count as often as they come."""
    counted = rows.select("split", row_digest(*columns).alias("h")).groupBy("split", "h").agg(F.count("*").alias("c"))
    level = counted.groupBy("split", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("c").alias("n"), _joined(F.concat_ws(":", "h", F.col("c").cast("string"))).alias("h"))
    return level.select("split", F.lit(digits).alias("digits"), "bucket", "n", "h")


def tree(leaf: DataFrame, digits: int = 4) -> DataFrame:
    """All levels (split, digits, bucket, n, h) above and with ``leaf``; the root has no digits. 256 children a node at most."""
    out = level = leaf
    for left in range(digits - 2, -1, -2):
        up = level.groupBy("split", F.substring("bucket", 1, left).alias("up")).agg(F.sum("n").alias("n"), _joined(F.concat_ws(":", "bucket", "h")).alias("h"))
        level = up.select("split", F.lit(left).alias("digits"), F.col("up").alias("bucket"), "n", "h")
        out = out.unionByName(level)
    return out


def differing(a: DataFrame, b: DataFrame, digits: int = 4) -> DataFrame:
    """(split, bucket) of the leaves in which two stored trees differ: below a node that is the same nothing is looked at."""
    wrong = None
    for at in range(0, digits + 1, 2):
        left, right = (t.filter(F.col("digits") == at).select("split", "bucket", F.col("h").alias(f"h{k}")) for k, t in enumerate((a, b)))
        if wrong is not None:
            above = wrong.select("split", F.col("bucket").alias("up"))
            left, right = (t.withColumn("up", F.substring("bucket", 1, at - 2)).join(above, ["split", "up"], "left_semi").drop("up") for t in (left, right))
        wrong = left.join(right, ["split", "bucket"], "full").filter(~F.col("h0").eqNullSafe(F.col("h1"))).select("split", "bucket")
    return wrong


def in_buckets(rows: DataFrame, buckets: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """``rows`` with their digest h, those of ``buckets`` (split, bucket) only; 16 ** ``digits`` for each split at most."""
    hashed = rows.withColumn("h", row_digest(*columns)).withColumn("bucket", F.substring("h", 1, digits))
    return hashed.join(buckets, ["split", "bucket"], "left_semi").drop("bucket")


def differing_rows(before: DataFrame, after: DataFrame, buckets: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """(split, h, n_before, n_after) of the rows, known by their digests, that the two versions hold unequally often."""
    counts = [in_buckets(t, buckets, *columns, digits=digits).groupBy("split", "h").agg(F.count("*").alias(name)) for name, t in (("n_before", before), ("n_after", after))]
    both = counts[0].join(counts[1], ["split", "h"], "full").select("split", "h", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_before", "n_after")))
    return both.filter("n_before <> n_after")


def rehashed(kept: DataFrame, after: DataFrame, buckets: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """The tree of ``after`` from the ``kept`` one of an earlier version that differs from it in ``buckets`` alone: only their rows are brought together."""
    fresh = leaves(in_buckets(after, buckets, *columns, digits=digits).drop("h"), *columns, digits=digits)
    rest = kept.filter(F.col("digits") == digits).join(buckets, ["split", "bucket"], "left_anti").select("split", "digits", "bucket", "n", "h")
    return tree(rest.unionByName(fresh), digits)
