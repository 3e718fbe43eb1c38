"""Classification metrics: one grouping by language, true and predicted label; all else is on that tiny table."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.schema import LABELS


def _grid(rows: DataFrame, *columns: str) -> DataFrame:
    spark = rows.sparkSession
    out = None
    for c in columns:
        labels = spark.createDataFrame([(x, k) for k, x in enumerate(LABELS)], f"{c} string, {c}_order int")
        out = labels if out is None else out.crossJoin(labels)
    return out


def confusion_matrix(pairs: DataFrame, true: str = "label", predicted: str = "predicted", *by: str) -> DataFrame:
    """(*by, label, predicted, n): every cell of the four labels, zeros too; pairs outside are left out."""
    counts = pairs.groupBy(*by, F.col(true).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    cells = _grid(pairs, "label", "predicted").select("label", "predicted")
    if by:
        cells = counts.select(*by).distinct().crossJoin(cells)
    return cells.join(counts, [*by, "label", "predicted"], "left").select(*by, "label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(matrix: DataFrame, *by: str) -> DataFrame:
    """(*by, label, support, precision, recall, f1); 0 where undefined."""
    right = F.col("label") == F.col("predicted")
    rows = matrix.groupBy(*by, "label").agg(F.sum("n").alias("support"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("hit"))
    columns = matrix.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    p, r = _ratio(F.col("hit"), F.col("said")), _ratio(F.col("hit"), F.col("support"))
    out = rows.join(columns, [*by, "label"]).withColumn("precision", p).withColumn("recall", r)
    return out.select(*by, "label", "support", "precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def macro_f1(matrix: DataFrame, *by: str) -> DataFrame:
    """Mean F1 over all four labels, those that don't occur as 0."""
    return per_class(matrix, *by).groupBy(*by).agg((F.sum("f1") / len(LABELS)).alias("macro_f1"))


def accuracy(pairs: DataFrame, true: str = "label", predicted: str = "predicted", *by: str) -> DataFrame:
    """Equal pairs over all pairs, also those outside the labels; 0 without pairs."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(F.col(true) == F.col(predicted), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))


def wilson(hits: Column, total: Column, z: float = 1.96) -> Column:
    """struct(low, high): Wilson interval of a share, within 0 and 1; (0, 0) without cases."""
    n, p = total.cast("double"), hits / total
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    whole = 1 + z * z / n
    some = total > 0
    return F.struct(F.when(some, F.greatest(F.lit(0.0), (middle - spread) / whole)).otherwise(0.0).alias("low"), F.when(some, F.least(F.lit(1.0), (middle + spread) / whole)).otherwise(0.0).alias("high"))


def metrics_by(pairs: DataFrame, by: str) -> DataFrame:
    """(by, n, accuracy, macro_f1) for each value of ``by``: one aggregation, a row for each value."""
    label, predicted = F.col("label"), F.col("predicted")
    known = label.isin(*LABELS) & predicted.isin(*LABELS)  # pairs outside the matrix count for accuracy only
    counts = [c for k, x in enumerate(LABELS) for c in (F.count_if(known & (label == x)).alias(f"_t{k}"), F.count_if(known & (predicted == x)).alias(f"_p{k}"), F.count_if((label == x) & (predicted == x)).alias(f"_h{k}"))]
    sums = pairs.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.when(label == predicted, 1.0).otherwise(0.0)).alias("accuracy"), *counts)
    f1 = F.lit(0.0)
    for k in range(len(LABELS)):
        f1 = f1 + _ratio(2 * F.col(f"_h{k}"), F.col(f"_t{k}") + F.col(f"_p{k}"))
    return sums.select(by, "n", "accuracy", (f1 / len(LABELS)).alias("macro_f1"))


def transaction_report(pairs: DataFrame) -> DataFrame:
    """(n, filled, accuracy, recall, precision, low, high) with the Wilson interval of TRANSACTION recall."""
    true, said = F.col("label") == "TRANSACTION", F.col("predicted") == "TRANSACTION"
    sums = pairs.agg(F.count("*").alias("n"), F.count_if("filled").alias("filled"), F.coalesce(F.avg(F.when(F.col("label") == F.col("predicted"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"), F.count_if(true & said).alias("hit"), F.count_if(true).alias("wanted"), F.count_if(said).alias("said"))
    return sums.select("n", "filled", "accuracy", _ratio(F.col("hit"), F.col("wanted")).alias("recall"), _ratio(F.col("hit"), F.col("said")).alias("precision"), wilson(F.col("hit"), F.col("wanted"))["low"].alias("low"), wilson(F.col("hit"), F.col("wanted"))["high"].alias("high"))


def collapse_gate(pairs: DataFrame, predicted: str = "predicted", least: int = 8) -> DataFrame:
    """FAIL if all of ``least`` or more predictions are one class."""
    few = F.count_distinct(F.col(predicted))
    return pairs.agg(F.count("*").alias("n"), few.alias("n_classes")).withColumn("status", F.when((F.col("n_classes") == 1) & (F.col("n") >= least), "FAIL").otherwise("PASS"))


def budget_gate(candidate: DataFrame, baseline: DataFrame, recall_drop: float = 0.005, f1_drop: float = 0.01) -> DataFrame:
    """Whether a candidate (transaction_recall, macro_f1) stays within the allowed drops of a baseline."""
    both = candidate.select(F.col("transaction_recall").alias("r1"), F.col("macro_f1").alias("f1")).crossJoin(baseline.select(F.col("transaction_recall").alias("r0"), F.col("macro_f1").alias("f0")))
    ok = (F.col("r0") - F.col("r1") <= recall_drop) & (F.col("f0") - F.col("f1") <= f1_drop)
    return both.select((F.col("r0") - F.col("r1")).alias("recall_drop"), (F.col("f0") - F.col("f1")).alias("f1_drop"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight) = total / (labels * count), counts of 0 as 1, for each of the four labels."""
    counts = rows.filter(F.col(label).isin(*LABELS)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    dense = _grid(rows, "label").select("label").join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())
    return dense.select("label", (total / (len(LABELS) * F.greatest(F.col("n"), F.lit(1)))).alias("weight"))


def topped_up(rows: DataFrame, extra: DataFrame, key: str, least: int) -> DataFrame:
    """``rows``, and if they are fewer than ``least`` as many of ``extra`` as are missing, in the order of ``key``."""
    short = least - rows.count()
    return rows if short <= 0 else rows.unionByName(extra.orderBy(key).limit(short).select(*rows.columns))


def prediction_agreement(a: DataFrame, b: DataFrame, key: str, gate: float = 0.99) -> DataFrame:
    """(n, agreement, status): how often the first maxima of two score tables (key, probs) are the same label."""

    def top(probs: str) -> Column:
        return F.array_position(probs, F.array_max(probs))

    both = a.select(key, F.col("probs").alias("pa")).join(b.select(key, F.col("probs").alias("pb")), key)
    out = both.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(top("pa") == top("pb"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("agreement"))
    return out.withColumn("status", F.when(F.col("agreement") >= gate, "PASS").otherwise("FAIL"))


def latency_summary(rows: DataFrame, value: str, ranges: int = 256) -> DataFrame:
    """(n, p50, p95, p99): the value at index floor((n - 1) * p) of the sorted values. Nulls are left out.

    Values are counted and cut into ranges at approximate quantiles. The ranges' counts tell in which ones the three
    indices lie; only the distinct values of these are put in order, so no task holds all values.
    """
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = counts.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10_000).alias("cuts"))  # one row
    placed = counts.crossJoin(F.broadcast(cuts)).select("v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("at"))
    sums = placed.groupBy("at").agg(F.sum("c").alias("held"))  # ``ranges`` rows
    total = sums.select("at", "held", F.coalesce(F.sum("held").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy()).alias("n"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.floor((F.col("n") - 1) * p).alias("index")) for name, p in shares.items()))
    ends = total.select("at", "before", "held", "n", F.explode(wanted).alias("w")).filter("w.index >= before AND w.index < before + held").select("at", "before", "n", "w.*")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.join(F.broadcast(ends), "at").withColumn("upto", upto)  # three ranges
    return found.filter("upto > index").groupBy().pivot("name", list(shares)).agg(F.min("v")).crossJoin(sums.agg(F.sum("held").alias("n"))).select("n", *shares)




def quantile_buckets(rows: DataFrame, at: str, value: str, by: str, every: str = "1 hour", accuracy: float = 0.01) -> DataFrame:
    """(window_start, by, sign, bucket, n): a mergeable sketch of ``value`` for each span of time and each ``by``.

    Buckets grow by the factor (1 + accuracy) / (1 - accuracy), so any value is within ``accuracy`` of its bucket's, and a sketch
    holds as many buckets as the logarithm of its values has steps, however many rows there are. Nulls are left out.
    """
    step = math.log((1 + accuracy) / (1 - accuracy))
    x = F.col(value).cast("double")
    kept = rows.filter(F.col(value).isNotNull()).select(F.window(F.col(at).cast("timestamp"), every)["start"].alias("window_start"), by, F.signum(x).cast("int").alias("sign"), F.when(x != 0, F.ceil(F.log(F.abs(x)) / step)).otherwise(0).alias("bucket"))
    return kept.groupBy("window_start", by, "sign", "bucket").agg(F.count("*").alias("n"))


def merged_quantiles(buckets: DataFrame, by: str, accuracy: float = 0.01, shares: Mapping[str, float] = {"p50": 0.5, "p95": 0.95, "p99": 0.99}) -> DataFrame:  # noqa: B006
    """(by, n, p50, p95, p99) of the sketches in ``buckets``, of whatever spans: each within ``accuracy`` of the exact value.

    The exact one stands at index floor((n - 1) * p) of the sorted values. Windows run over merged buckets, never over rows.
    """
    factor = (1 + accuracy) / (1 - accuracy)
    merged = buckets.groupBy(by, "sign", "bucket").agg(F.sum("n").alias("n")).withColumn("value", F.col("sign") * 2 * F.pow(F.lit(factor), F.col("bucket")) / (factor + 1))
    order = Window.partitionBy(by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = merged.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    picked = (F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * p), F.col("value"))).alias(name) for name, p in shares.items())
    return upto.groupBy(by).agg(F.sum("n").alias("n"), *picked)
