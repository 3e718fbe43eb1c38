"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is spent in complete epochs first. What is left buys a weighted sample without replacement: each
document draws the exponential key -ln(u) / quality, documents are taken in the order of their keys, and the prefix sum of
their sizes stops at the budget. u comes from a digest of seed, doc_id and text, so reruns agree whatever the partitioning.

The prefix sum is made in levels. A source's rows are cut into ranges at quantiles of their keys, the sums of the ranges tell
in which one the budget ends, and only that one is cut again, until it has ``bucket_rows`` rows at most. Only these are sorted.
Where all keys of a range are equal (rows that repeat) it is cut by row number, so no source and no tie passes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._common import WORDS, Scratch, numbered, read, text_of, with_groups

SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """(source, n_rows, source_size, target) from (source, n_rows, source_size), one row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn. Targets sum to ``share`` of all sizes; none is
    above ``most`` times its source's size, and what that leaves is shared again by weight. That is the level at which
    min(most * size, level * weight) sums to the whole: sources in the order of size / weight reach their limit one by
    one, and the level is read off at the first that doesn't. The windows hold one row for each source, never documents.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (turn % len(weights) + 1).cast("int")).cast("long")
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = (
        sizes.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("level", left / weight_left)
    )
    levels = levels.withColumn("at", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source"))).over(whole))
    target = F.least(F.col("limit").cast("double"), F.coalesce("at", F.lit(0.0)) * F.col("weight"))
    return levels.select("source", "n_rows", "source_size", target.alias("target"))


def sampling_key(seed: str, quality: Column) -> Column:
    """-ln(u) / quality with u from the first 52 bits of md5(seed:doc_id:md5(text)); null ids and texts count as empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text_of())))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality


def boundaries(rows: DataFrame, targets: DataFrame, scratch: Scratch, bucket_rows: int, ranges: int = 32) -> DataFrame:
    """(of_source, low, high, low_row, high_row, left): for each source with a budget the range of keys in which it ends.

    Rows with low < key <= high, and if low = high those with low_row < row <= high_row, are in the range; ``left`` is what
    the rows before it leave of the budget. The range has ``bucket_rows`` rows at most. ``targets`` has one row for each source.
    """
    state = targets.filter("budget > 0").select("of_source", F.lit(-1.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(-1).cast("long").alias("low_row"), F.lit((1 << 63) - 1).alias("high_row"), F.col("budget").alias("left"), F.col("n_rows").alias("n"))
    state, level = scratch.table(state, "range0"), 0
    while state.filter(F.col("n") > bucket_rows).limit(1).count():
        # The many rows of a source meet its one row: sources with many rows are broadcast, a thousand at most.
        wide = scratch.table(state.filter(F.col("n") > bucket_rows), "wide")
        live = with_groups(rows, wide, ["of_source"], "n").filter(in_range())
        live = scratch.table(live.select("of_source", "low", "high", "low_row", "high_row", "left", "key", "row", "size"), f"live{level}")
        cuts = live.groupBy("of_source").agg(
            (F.min("key") == F.max("key")).alias("tied"), F.min("key").alias("only"), F.count("*").alias("held"),
            F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 1000).alias("keys"), F.percentile_approx("row", [k / ranges for k in range(1, ranges)], 1000).alias("rows"),
        )
        cuts = scratch.table(cuts, "cuts")
        cut = with_groups(live, cuts, ["of_source"], "held")
        # Keys equal to a cut are a range of their own, so a range of unequal keys always gets smaller.
        by_key = F.size(F.filter("keys", lambda x: x < F.col("key"))) + F.size(F.filter("keys", lambda x: x <= F.col("key")))
        at = F.when(F.col("tied"), F.size(F.filter("rows", lambda x: x < F.col("row")))).otherwise(by_key)
        sums = cut.withColumn("at", at).groupBy("of_source", "at").agg(F.sum("size").alias("held_size"), F.count("*").alias("n"), F.max("key").alias("key"), F.max("row").alias("row"), F.first("tied").alias("tied"), F.first("only").alias("only"), *(F.first(c).alias(c) for c in ("low", "high", "low_row", "high_row", "left")))
        # A row for each range: at most 2 * ``ranges`` for each source.
        order = Window.partitionBy("of_source").orderBy("at")
        sums = sums.withColumn("before", F.coalesce(F.sum("held_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("key_before", F.lag("key").over(order)).withColumn("row_before", F.lag("row").over(order))
        ends = sums.filter("before < left AND before + held_size >= left")
        low = F.when(F.col("tied"), F.col("only")).otherwise(F.coalesce("key_before", "low"))
        high = F.when(F.col("tied"), F.col("only")).otherwise(F.col("key"))
        low_row = F.when(F.col("tied"), F.coalesce("row_before", "low_row")).otherwise(F.col("low_row"))
        high_row = F.when(F.col("tied"), F.col("row")).otherwise(F.col("high_row"))
        after = ends.select("of_source", low.alias("low"), high.alias("high"), low_row.alias("low_row"), high_row.alias("high_row"), (F.col("left") - F.col("before")).alias("left"), "n")
        level += 1
        state = scratch.table(state.filter(F.col("n") <= bucket_rows).unionByName(after), f"range{level}")
        scratch.drop(f"range{level - 1}", f"live{level - 1}", "cuts", "wide")
    return state.drop("n")


def in_range() -> Column:
    tied = F.col("low") == F.col("high")
    return F.when(tied, (F.col("key") == F.col("low")) & (F.col("row") > F.col("low_row")) & (F.col("row") <= F.col("high_row"))).otherwise((F.col("key") > F.col("low")) & (F.col("key") <= F.col("high")))


def before_range() -> Column:
    return F.when(F.col("low") == F.col("high"), (F.col("key") < F.col("low")) | (F.col("key") == F.col("low")) & (F.col("row") <= F.col("low_row"))).otherwise(F.col("key") <= F.col("low"))


def mix_sources(documents: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0, seed: str = SEED, bucket_rows: int = 10_000, scratch: Scratch | None = None, keep: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, epochs, taken) for each row of ``documents`` (doc_id, source, text).

    size is the number of words; null text has none. ``quality`` (doc_id, weight) gives positive weights; a document
    without one weighs 1, and of several the largest holds. epochs is the number of complete passes over the row's source
    and taken the words that the mix takes of the row in all; the last document of a sample is taken in part, so that a
    source's words meet its target to within one. Null sources are one source, the last. Rows equal in doc_id and text
    draw the same key; which of them is taken doesn't matter. An empty table gives an empty result; sources without words
    take none. ``keep`` names a column to carry along.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    carried = [F.col(keep).alias("carried")] if keep else []
    rows = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text"), *carried).withColumn("size", F.regexp_count(text_of(), F.lit(WORDS)).cast("long"))
    rows = rows.withColumn("draw", sampling_key(seed, F.lit(1.0))).drop("text")
    if quality is not None:
        best = quality.filter("weight > 0").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("weight").cast("double")).alias("quality"))
        rows = scratch.table(rows, "drawn")
        groups = scratch.table(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).join(best, "doc_id"), "weighted")
        # Rows without an id have no weight and would all meet in one task.
        rows = with_groups(rows.filter("doc_id IS NOT NULL"), groups, ["doc_id"], "n", "left").unionByName(rows.filter("doc_id IS NULL"), allowMissingColumns=True)
    else:
        rows = rows.withColumn("quality", F.lit(1.0))
    # A source has a name of its own in joins: null is one of them.
    named = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = rows.withColumn("key", F.col("draw") / F.coalesce("quality", F.lit(1.0))).drop("quality", "draw")
    rows = scratch.table(rows.withColumn("of_source", named).withColumn("row", F.monotonically_increasing_id()), "sizes")
    scratch.drop("drawn", "weighted")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most, share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    targets = scratch.table(targets.withColumn("epochs", epochs).withColumn("budget", budget).withColumn("of_source", named).drop("source"), "targets")
    ends = boundaries(rows, targets, scratch, bucket_rows)
    plan = scratch.table(targets.join(ends, "of_source", "left"), "plan")
    placed = with_groups(rows, plan, ["of_source"], "n_rows")
    ends_here = (F.col("budget") > 0) & F.coalesce(in_range(), F.lit(False))
    # What stands before the range is taken; in the range, of ``bucket_rows`` rows at most, the prefix sum decides.
    sampled = F.when((F.col("budget") > 0) & F.coalesce(before_range(), F.lit(False)), F.col("size")).otherwise(0)
    within = Window.partitionBy("of_source").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    partly = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(within), F.lit(0))))
    decided = placed.filter(~ends_here).withColumn("sampled", sampled).unionByName(placed.filter(ends_here).withColumn("sampled", partly))
    return decided.select("doc_id", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("sampled")).cast("long").alias("taken"), *(["carried"] if keep else []))


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels (doc_id, quality): 2 for good, 0.5 for poor documents."""
    return labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def mixed_documents(documents: DataFrame, quality: DataFrame | None = None, scratch: Scratch | None = None, **options) -> DataFrame:
    """``documents`` as often as the mix takes them, columns unchanged, whatever their names.

    A row comes once for each complete epoch and once more if half of it or more is in the sample; so a row without words
    comes once more as well. Each row is decided for itself, with or without a doc_id. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    rows, row = numbered(documents, scratch, "numbered")
    mix = mix_sources(rows, quality, scratch=scratch, keep=row, **options)
    half = F.when(2 * (F.col("taken") - F.col("epochs") * F.col("size")) >= F.col("size"), 1).otherwise(0)
    copies = mix.select(F.col("carried").alias(row), F.explode(F.array_repeat(F.lit(0), (F.col("epochs") + half).cast("int"))))
    return rows.join(copies.select(row), row).select(*documents.columns)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), label_quality(read(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '{WORDS}'))::BIGINT AS size,
    -ln((('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / coalesce(q.w, 1.0::DOUBLE) AS key
  FROM documents d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight::DOUBLE AS ratio FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE) / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER b, 0)::DOUBLE) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), 0) * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - start)))::BIGINT AS taken FROM p
"""
