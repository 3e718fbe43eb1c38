"""The most frequent values, exactly, without shuffling every distinct one: a mergeable sketch, then a recount of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: As many values as Spark's sketch can keep.
MOST_TRACKED = 1_000_000


def error_bound(rows: int, tracked: int) -> float:
    """By how much an estimate can be above the count: 3.5 rows in each place of the sketch's table, three quarters of which is used."""
    places = 1
    while places * 3 < tracked * 4:
        places *= 2
    return 3.5 * rows / places


def candidates(values: DataFrame, column: str, n: int, tracked: int = 16_384) -> tuple[DataFrame, float] | None:
    """(value, estimate) of all that can be among the ``n`` most frequent, and the error bound; None if no sketch is large enough.

    Every partition keeps a table of bounded size, and tables are merged, so what is shuffled doesn't grow with the distinct
    values. An estimate is at most ``bound`` above the count. The n-th largest count is at least the n-th largest estimate
    less the bound; a value that the table lost has at most the bound. If that could be enough, a larger table is taken.
    Rows are counted in the pass that makes the sketch.
    """
    while True:
        tracked = min(max(tracked, n), MOST_TRACKED)
        kept = values.filter(F.col(column).isNotNull()).agg(F.expr(f"approx_top_k(`{column}`, {tracked}, {tracked})").alias("top"), F.count("*").alias("rows")).persist()  # one row
        top = kept.select(F.inline("top")).toDF("value", "estimate")  # ``tracked`` rows at most
        try:
            rows = kept.first()["rows"]
            bound = error_bound(rows, tracked)
            held, counted = top.agg(F.count("*"), F.sum("estimate")).first()
            least = top.orderBy(F.desc("estimate")).limit(n).agg(F.min("estimate")).first()[0] if held >= n else 0
            # All rows are accounted for: no value was lost, and estimates are counts.
            whole = (counted or 0) == rows
            if whole or least - bound > bound:
                chosen = top.filter(F.col("estimate") >= (0 if whole else least - bound))
                return values.sparkSession.createDataFrame(chosen.collect(), top.schema), 0.0 if whole else bound
        finally:
            kept.unpersist()
        if tracked == MOST_TRACKED:
            return None
        tracked *= 4


def most_frequent(values: DataFrame, column: str, n: int, tracked: int = 16_384, totals: DataFrame | None = None) -> DataFrame:
    """(value, count): the ``n`` most frequent values of ``column``, ties in the order of the values. Nulls aren't counted.

    Only candidates are counted exactly, by partial sums; of values too evenly spread for any sketch all are. ``totals`` (the
    column, n): the same values with how often each is there, in parts that add up, if they come cheaper than one by one.
    """
    found = candidates(values, column, n, tracked)
    counted = values.withColumn("n", F.lit(1)) if totals is None else totals
    rows = counted.select(F.col(column).alias("value"), "n").filter("value IS NOT NULL")
    if found is not None:
        rows = rows.join(F.broadcast(found[0].select("value")), "value", "left_semi")  # ``MOST_TRACKED`` values at most
    return rows.groupBy("value").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "value").limit(n)
