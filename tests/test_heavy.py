"""Most frequent values by sketch and recount against plain counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators.heavy import candidates, error_bound, most_frequent


def plain(rows, n):
    return sorted(((v, c) for v, c in Counter(r for r in rows if r is not None).items()), key=lambda x: (-x[1], x[0]))[:n]


def frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "v string").repartition(6)


@pytest.mark.parametrize(("n", "tracked"), [(5, 16), (20, 64), (50, 16_384), (3000, 4096)])
def test_most_frequent_values(spark, n, tracked):
    rng = random.Random(n)
    rows = [f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(30_000)] + [None, None, "", "é"]
    assert [tuple(r) for r in most_frequent(frame(spark, rows), "v", n, tracked).collect()] == plain(rows, n)


def test_the_table_grows_until_the_bound_is_met(spark):
    rows = [f"w{k}" for k in range(100) for _ in range(200 if k < 10 else 100)] + [f"x{k}" for k in range(20_000)]
    found, bound = candidates(frame(spark, rows), "v", 10, 16)
    held = {r.value: r.estimate for r in found.collect()}
    counts = Counter(rows)
    assert all(counts[v] <= e <= counts[v] + bound for v, e in held.items()) and {f"w{k}" for k in range(10)} <= set(held)
    assert len(held) < 1000 and bound < 100 and error_bound(40_000, 16) > 1000


def test_odd_values(spark):
    assert most_frequent(frame(spark, []), "v", 3).collect() == []
    assert most_frequent(frame(spark, [None]), "v", 3).collect() == []
    tied = [f"t{k}" for k in range(500)] * 2
    assert [tuple(r) for r in most_frequent(frame(spark, tied), "v", 7).collect()] == plain(tied, 7)


def test_evenly_spread_values_are_all_counted(spark, monkeypatch):
    from textloom.operators import heavy

    monkeypatch.setattr(heavy, "MOST_TRACKED", 64)
    rows = [f"t{k}" for k in range(3000)] * 2
    assert candidates(frame(spark, rows), "v", 5, 16) is None
    assert [tuple(r) for r in most_frequent(frame(spark, rows), "v", 5, 16).collect()] == plain(rows, 5)


def test_rows_are_counted_with_the_sketch_and_totals_add_up(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    values = spark.range(3000).selectExpr("concat('v', CAST(sqrt(id) AS INT)) AS v").coalesce(1)
    found, bound = candidates(values.mapInArrow(counted, values.schema), "v", 5, tracked=1024)
    assert made.value == 3000 and bound == 0
    parts = values.groupBy("v").agg(F.count("*").alias("n"))
    wanted = [tuple(r) for r in most_frequent(values, "v", 5).collect()]
    assert [tuple(r) for r in most_frequent(values, "v", 5, totals=parts.unionByName(parts.limit(0))).collect()] == wanted
