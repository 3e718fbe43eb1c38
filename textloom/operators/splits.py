"""Group splits, leakage audits and reproducible samples. Randomness is md5(seed:key), so partitioning never matters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.key_filter import KeyFilter
from textloom.schema import SPLITS


def group_key(*columns: str) -> Column:
    return F.concat_ws("::", *(F.coalesce(F.col(c), F.lit("")) for c in columns))


def order_digest(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ranked(keys: DataFrame, digest: str = "digest", bits: int = 12) -> DataFrame:
    """``keys`` with ``rank`` from 0 in the order of ``digest`` (32 hex digits).

    Ranks are counted within ranges of the digest, of which there are 2**bits, and shifted by the sizes of the ranges before;
    only the ranges' counts, a fixed number of rows, pass one window.
    """
    bucket = F.shiftright(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), 16 - bits)
    rows = keys.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(digest)
    return rows.join(F.broadcast(offsets), "_bucket").withColumn("rank", F.row_number().over(inside) - 1 + F.col("_before")).drop("_bucket", "_before")


def split_groups(rows: DataFrame, group: Column, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42, mode: str = "exact") -> DataFrame:
    """``rows`` with ``split``: groups in the order of their digests, cut at int(n * ratio) and the rest to test.

    ``hash`` compares each group's digest with the cut instead: no shuffle, and a group keeps its split when rows are added.
    """
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    if mode == "hash":
        at = F.conv(F.substring(order_digest(seed, group), 1, 8), 16, 10).cast("double") / float(1 << 32)
        return rows.withColumn("split", F.when(at < ratios[0], SPLITS[0]).when(at < ratios[0] + ratios[1], SPLITS[1]).otherwise(SPLITS[2]))
    keyed = rows.withColumn("_group", group)
    groups = keyed.select("_group").distinct().withColumn("digest", order_digest(seed, F.col("_group")))
    n = groups.agg(F.count("*").alias("_n"))
    first, second = F.floor(F.col("_n") * ratios[0]), F.floor(F.col("_n") * ratios[1])
    named = ranked(groups).crossJoin(F.broadcast(n)).select("_group", F.when(F.col("rank") < first, SPLITS[0]).when(F.col("rank") < first + second, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))
    return keyed.join(named, "_group").drop("_group")


def known_split(split: Column) -> Column:
    """A split outside the three counts as train."""
    return F.when(split.isin(*SPLITS), split).otherwise("train")


def can_be_shared(keyed: DataFrame, largest: str = SPLITS[0]) -> DataFrame:
    """The rows of ``keyed`` (value, split) whose value may stand in two splits: all but those of the largest split that a
    filter over the values of the others stops. Without a filter, which is made only up to a size, all rows."""
    others = keyed.filter(F.col("split") != largest)
    found = KeyFilter.build(others.select("value").distinct(), ["value"])
    return keyed if found is None else others.unionByName(keyed.filter(F.col("split") == largest).filter(found.may_hold("value")))


def shared_between_splits(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """(kind, left_split, right_split, value) of each value of ``key`` that stands in two splits."""
    keyed = can_be_shared(rows.select(key.alias("value"), known_split(F.col("split")).alias("split")))
    held = keyed.groupBy("value").agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)
    a, b = held.select("value", "splits", F.explode("splits").alias("left_split")), F.explode("splits").alias("right_split")
    return a.select("value", "left_split", b).filter("left_split < right_split").select(F.lit(name).alias("kind"), "left_split", "right_split", "value")


def leaked_parents(rows: DataFrame) -> DataFrame:
    """Rows of test whose parent stands in another split; of several parents of one id the last by split counts."""
    children = rows.filter(known_split(F.col("split")) == "test").filter("parent_id IS NOT NULL AND parent_id <> ''").select("id", "parent_id")
    named = rows.select(F.col("id").alias("parent_id"), known_split(F.col("split")).alias("split"))
    found = KeyFilter.build(children.select("parent_id").distinct(), ["parent_id"])
    parents = (named if found is None else named.filter(found.may_hold("parent_id"))).groupBy("parent_id").agg(F.max("split").alias("parent_split"))
    return children.join(parents, "parent_id").filter("parent_split <> 'test'").select(F.lit("parent").alias("kind"), F.col("parent_split").alias("left_split"), F.lit("test").alias("right_split"), F.col("id").alias("value"))


def leakage_audit(rows: DataFrame, group_columns: Sequence[str] = ("template_group", "sender_group")) -> DataFrame:
    """(kind, n, status) for ids, groups, parents and, as a warning, templates alone; ``all`` sums the first three."""
    found = shared_between_splits(rows, F.col("id"), "id").union(shared_between_splits(rows, group_key(*group_columns), "group"))
    if "parent_id" in rows.columns:
        found = found.union(leaked_parents(rows))
    found = found.union(shared_between_splits(rows, F.col(group_columns[0]), "template_only"))
    counts = found.groupBy("kind").agg(F.count("*").alias("n"))
    kinds = rows.sparkSession.createDataFrame([(k,) for k in ("id", "group", "parent", "template_only")], "kind string")
    each = kinds.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
    every = each.filter("kind <> 'template_only'").agg(F.lit("all").alias("kind"), F.sum("n").alias("n"))
    status = F.when(F.col("n") == 0, "PASS").when(F.col("kind") == "template_only", "WARN").otherwise("FAIL")
    return each.union(every).select("kind", "n", status.alias("status"))


def top_of_each(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: Column | int) -> DataFrame:
    """The first ``n`` rows of each value of ``by``, with ``_rank`` from 1. Spark prunes each partition to its own first rows."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= n)


def sample_per_class(rows: DataFrame, label: str, key: str, per_class: int, total: int, seed: int = 42) -> DataFrame:
    """Up to ``per_class`` rows of each label in the order of their digests, then the next of all others up to ``total``."""
    drawn = rows.withColumn("_digest", order_digest(seed, F.col(key)))
    picked = top_of_each(drawn, [label], [F.col("_digest")], per_class).drop("_rank")
    rest = drawn.join(picked.select(key), key, "left_anti")
    n = picked.count()
    return picked.unionByName(rest.orderBy("_digest").limit(max(0, total - n)).select(*picked.columns)).drop("_digest")


def sample_even(rows: DataFrame, label: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """An equal quota for each label that occurs, topped up from the rest."""
    n = rows.select(label).distinct().count()
    return sample_per_class(rows, label, key, size // max(1, n), size, seed)


def freeze_sample(rows: DataFrame, cell: Sequence[str], template: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """``target`` rows of each cell, in turn from its templates: every template's first row comes before any second."""
    drawn = rows.withColumn("_digest", order_digest(seed, F.col(key))).withColumn("_template", order_digest(seed, F.col(template)))
    turn = F.row_number().over(Window.partitionBy(*cell, template).orderBy("_digest"))
    # A row behind ``target`` of its own template is behind as many in its cell, so partitions keep their first rows only.
    return top_of_each(drawn.withColumn("_turn", turn).filter(F.col("_turn") <= target), cell, [F.col("_turn"), F.col("_template"), F.col("_digest")], target).drop("_rank", "_turn", "_digest", "_template")


def shortfall(sample: DataFrame, cells: DataFrame, cell: Sequence[str], target: int) -> DataFrame:
    """Each cell with how many rows it has and lacks; cells without rows too."""
    counts = sample.groupBy(*cell).agg(F.count("*").alias("have"))
    have = F.coalesce("have", F.lit(0))
    return cells.join(counts, list(cell), "left").select(*cell, have.alias("have"), F.lit(target).alias("target"), F.greatest(F.lit(0), target - have).alias("shortfall"))


def dual_pack(pool: DataFrame, annotators: Sequence[str] = ("A", "B")) -> DataFrame:
    """One blank copy of ``pool`` for each annotator, ids unchanged."""
    copies = pool.withColumn("pack", F.explode(F.array(*(F.lit(a) for a in annotators))))
    return copies.withColumn("label", F.lit("")).withColumn("annotator", F.lit(""))


def dual_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, label_a, label_b, status, gold): equal labels are gold, different ones go to adjudication."""
    both = a.select("id", F.col("label").alias("label_a")).join(b.select("id", F.col("label").alias("label_b")), "id", "full")
    status = F.when(F.col("label_a").isNull() | F.col("label_b").isNull(), "single").when(F.col("label_a") == F.col("label_b"), "gold").otherwise("adjudicate")
    return both.withColumn("status", status).withColumn("gold", F.when(status == "gold", F.col("label_a")))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """(n, observed, expected, kappa) of (label_a, label_b): one aggregate over the table of pairs."""
    cells = pairs.filter("label_a IS NOT NULL AND label_b IS NOT NULL").groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
    a = cells.groupBy(F.col("label_a").alias("label")).agg(F.sum("n").alias("na"))
    b = cells.groupBy(F.col("label_b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, "label").agg(F.sum(F.col("na") * F.col("nb")).alias("products"))
    whole = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("same"))
    out = whole.crossJoin(chance).select("n", (F.col("same") / F.col("n")).alias("observed"), (F.coalesce("products", F.lit(0)) / (F.col("n") * F.col("n"))).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))
