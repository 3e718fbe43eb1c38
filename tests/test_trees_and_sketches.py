"""Stored hash trees, quantile sketches over time, key filters, repairs of packs and samples by turn."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.operators import manifest, metrics
from textloom.operators.audits import content_manifest
from textloom.operators.key_filter import KeyFilter, anti_join, semi_join
from textloom.operators.labels import apply_repairs
from textloom.operators.splits import can_be_shared, freeze_sample


def splits(spark, rows):
    return spark.createDataFrame(rows, "split string, id string, text string")


def test_trees_find_what_differs_and_hash_only_that(spark):
    rng = random.Random(1)
    before = [(rng.choice(["train", "test"]), str(k), f"t{k}") for k in range(500)] + [("train", "x", None), ("train", "1", "t1"), ("train", "1", "t1")]
    after = before[:100] + [(s, i, t + "!") for s, i, t in before[100:103]] + before[103:-1] + [("new", "n", "n")]
    a, b = splits(spark, before), splits(spark, after)
    trees = [manifest.tree(manifest.leaves(t, "id", "text", digits=2), 2).persist() for t in (a, b)]
    root = {r.split: (r.n, r.h) for r in trees[0].filter("digits = 0").collect()}
    assert root == {r.split: (r.n, r.content_hash) for r in content_manifest(a, "id", "text", digits=2).collect()}
    buckets = manifest.differing(*trees, 2).persist()
    rows = manifest.differing_rows(a, b, buckets, "id", "text", digits=2).collect()
    counts = [Counter((s, i, t) for s, i, t in v) for v in (before, after)]
    assert len(rows) == sum(counts[0][k] != counts[1][k] for k in set(counts[0]) | set(counts[1])) and 0 < buckets.count() <= len(rows)
    assert manifest.in_buckets(b, buckets, "id", "text", digits=2).count() < b.count() / 4
    again = manifest.rehashed(trees[0], b, buckets, "id", "text", digits=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, trees[1].collect()))
    assert manifest.differing(trees[0], trees[0], 2).count() == 0 and manifest.tree(manifest.leaves(a.limit(0), "id")).count() == 0


def test_sketches_of_hours_merge_to_any_span(spark):
    rng = random.Random(2)
    rows = [(f"2024-01-01 {h:02d}:{rng.randrange(60):02d}:00", rng.choice("ab"), rng.choice([rng.lognormvariate(2, 2), -rng.random(), 0.0])) for h in range(24) for _ in range(60)] + [("2024-01-01 05:00:00", "a", None)]
    frame = spark.createDataFrame(rows, "at string, kind string, v double")
    buckets = metrics.quantile_buckets(frame, "at", "v", "kind", accuracy=0.02).persist()
    for first, last in ((0, 24), (3, 5), (23, 24)):
        span = buckets.filter((F.hour("window_start") >= first) & (F.hour("window_start") < last))
        exact = defaultdict(list)
        for at, kind, v in rows:
            if first <= int(at[11:13]) < last and v is not None:
                exact[kind].append(v)
        for r in metrics.merged_quantiles(span, "kind", 0.02).collect():
            values = sorted(exact[r.kind])
            assert r.n == len(values)
            for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                wanted = values[int((len(values) - 1) * p)]
                assert abs(r[name] - wanted) <= 0.02 * abs(wanted) + 1e-9
    assert metrics.merged_quantiles(buckets.limit(0), "kind").count() == 0


def shuffled_rows(frame):
    """Rows that the exchanges of an executed plan have written, largest first."""
    frame.collect()
    plan, out = frame._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "Exchange" in node.nodeName() and node.metrics().contains("shuffleRecordsWritten"):
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())
        children = node.children()
        for k in range(children.length()):
            walk(children.apply(k))

    walk(plan)
    return sorted(out, reverse=True)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_what_passes_the_filter_is_shuffled(spark, no_broadcast):
    rows, keys = spark.range(20_000).selectExpr("id", "CAST(id AS STRING) AS t"), spark.range(19_900, 20_100)
    for join, wanted in ((anti_join, 19_900), (semi_join, 100)):
        plain = join(rows, keys, ["id"], most_bytes=0)
        filtered = join(rows, keys, ["id"])
        assert plain.count() == filtered.count() == wanted and filtered.columns == rows.columns
        assert max(shuffled_rows(plain)) >= 20_000 > 1000 > max(shuffled_rows(filtered))
    assert KeyFilter.build(keys, ["id"], most_bytes=8) is None
    held = KeyFilter.build(keys.limit(0), ["id"])
    assert rows.filter(held.may_hold("id")).count() == 0
    odd = spark.createDataFrame([(None,), ("",), ("é",)], "t string")
    assert sorted(map(repr, anti_join(odd, odd.filter("t = 'é'"), ["t"]).collect())) == ["Row(t='')", "Row(t=None)"]


def test_leakage_looks_only_at_values_of_small_splits(spark):
    rows = spark.range(10_000).selectExpr("CAST(id % 9000 AS STRING) AS value", "CASE WHEN id < 9800 THEN 'train' WHEN id < 9900 THEN 'test' ELSE 'validation' END AS split")
    assert can_be_shared(rows).count() < 600
    shared = {r.value for r in can_be_shared(rows).groupBy("value").agg(F.count_distinct("split").alias("n")).filter("n > 1").collect()}
    assert shared == {str(k) for k in range(800, 1000)}


def test_repairs_leave_their_traces(spark):
    rows = spark.createDataFrame([("1", " ad ", "old", ""), ("2", "AD", None, "me"), ("3", "FRAUD", "", "me"), ("4", None, "n", None)], "id string, label string, notes string, annotator string")
    decided = spark.createDataFrame([("1", "FRAUD", "r"), ("2", "FRAUD", "r"), ("3", "FRAUD", "r"), ("4", "", "r"), ("9", "AD", "r")], "id string, label string, reason string")
    got = {r.id: tuple(r)[1:] for r in apply_repairs(rows, decided).collect()}
    assert got == {"1": ("FRAUD", "[fix:r AD->FRAUD] old", "qa_fix_v1", True), "2": ("FRAUD", "[fix:r AD->FRAUD]", "me", True), "3": ("FRAUD", "", "me", False), "4": (None, "n", None, False)}
    assert apply_repairs(rows, decided, "fix_v2", "pass", overwrite=True).filter("id = '2'").first().annotator == "pass"


def test_top_up_and_turns(spark):
    few, more = spark.range(5).toDF("id"), spark.range(100, 200).toDF("id")
    assert [r.id for r in metrics.topped_up(few, more, "id", 8).orderBy("id").collect()] == [0, 1, 2, 3, 4, 100, 101, 102]
    assert metrics.topped_up(few, more, "id", 3).count() == 5 and metrics.topped_up(few, more.limit(0), "id", 9).count() == 5
    rows = spark.range(0, 5000, 1, 6).selectExpr("id", "id % 2 AS cell", "CASE WHEN id < 4970 THEN 't' ELSE CAST(id AS STRING) END AS template")
    sample = freeze_sample(rows, ["cell"], "template", "id", 20)
    assert sample.count() == 40 and sample.filter("template = 't'").groupBy("cell").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] == 5
    assert sample._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2 and max(shuffled_rows(sample)) < 1000
