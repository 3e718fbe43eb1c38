"""What a task holds and does stays the same as tables grow."""

import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import candidates, classify
from textloom.plans import file_queries, source_queries, split_queries, views
from textloom.schema import LABELS
from textloom.sources import readers, writers


def windows(raw, sizes=(2, 3)):
    return [raw[i : i + k].hex() for k in sizes for i in range(len(raw) - k + 1)]


def test_byte_ngrams_of_a_long_text_take_one_pass(spark):
    texts = ["é\n\r x" * 10_000, "\n\n", "ab\nc", "", None, "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    start = time.time()
    got = [r.g for r in rows.select(T.byte_ngrams(F.col("text")).alias("g")).collect()]
    assert got == [windows((t or "").encode()) for t in texts] and time.time() - start < 20


def test_bytes_that_pad_are_not_converted(spark):
    rows = spark.createDataFrame([("é",)], "text string").select(T.encode_bytes(F.col("text")).alias("ids"))
    assert rows.first().ids == [196, 170] + [0] * 510
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "xx" not in plan


def test_a_larger_table_is_dealt_over_more_tasks_by_its_key(spark, monkeypatch):
    monkeypatch.setattr(views, "PIECE", 4096)
    monkeypatch.setattr(views.pieces, "__defaults__", (4096,))
    orders = views.view(spark, "/root/testdata/sf0.001", "orders")
    assert orders.rdd.getNumPartitions() == -(-views.size_of(spark, "/root/testdata/sf0.001/orders.parquet") // 4096) > 4
    labelled = views.view(spark, "/root/testdata/sf0.001", "labelled")
    assert labelled.count() == 1500 and labelled.select("msg_id").distinct().count() == 1500


def test_ngrams_are_counted_where_they_arise(spark):
    rows = spark.createDataFrame([(k % 40, f"code {k} code") for k in range(200)], "id long, text string")
    words = T.ngram_rows(rows, F.col("text")).groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(50)
    counts = T.ngram_counts(rows, "text", "id", words, at_once=10)
    wanted = T.ngram_rows(rows, F.col("text"), "id").join(words, "gram").groupBy("id", "gram").agg(F.count("*").alias("n"))
    assert counts.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, wanted.collect()))


def test_one_file_in_order_is_written_without_a_sort_in_its_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    got = file_queries.in_order(spark, rows, "id", 5)
    assert [r.id for r in got.coalesce(1).collect()] == list(range(1000))
    assert "Sort" not in got.coalesce(1)._jdf.queryExecution().executedPlan().toString()


def test_batches_of_several_files_are_whole(spark, tmp_path):
    folder = str(tmp_path / "f")
    for rows in (spark.range(100), spark.range(100, 102), spark.range(0), spark.range(200, 260)):
        source_queries.write_files(spark, rows, folder, 3, "id")
    assert source_queries.parts_in(spark, folder) == 12
    stream, seen = spark.readStream.schema("id long").option("maxFilesPerTrigger", 3).parquet(folder), []
    stream.writeStream.foreachBatch(lambda batch, k: seen.append(sorted(r.id for r in batch.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [list(range(100)), [100, 101], [], list(range(200, 260))]


def test_validation_deals_rows_over_more_tasks_as_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(views.pieces, "__defaults__", (4096,))
    errors = split_queries.validate_messages(spark, "/root/testdata/sf0.001")
    n = views.pieces(spark, "/root/testdata/sf0.001/orders.parquet")
    assert n > 4 and "hashpartitioning(id#" in (plan := errors._jdf.queryExecution().executedPlan().toString()) and f", {n})" in plan


def test_texts_in_folders_are_listed_and_read_in_tasks(spark, tmp_path, monkeypatch):
    """The same files, names and texts as Spark's own reader gives, by tasks of a bounded number of files."""
    monkeypatch.setattr(readers, "FILES_AT_ONCE", 30)
    root = tmp_path / "é x%20"
    rows = spark.createDataFrame([(k // 50, ("ham", "spam", "other")[k % 3], k, f"  té\n{k} " if k % 7 else " ") for k in range(400)], "part long, label string, name long, text string")
    writers.write_labelled_text_dirs(rows, str(root))
    (root / "_hidden" / "ham").mkdir(parents=True)
    (root / "a" / "b=1" / "_c=2" / "spam").mkdir(parents=True)
    for path in ("_hidden/ham/1.txt", "0/ham/.2.txt", "0/ham/_3.txt", "0/ham/4.csv", "a/b=1/_c=2/spam/5 ü.txt", "ham.txt"):
        (root / path).write_bytes(b"x\xff")
    got = readers.read_labelled_text_dirs(spark, str(root))
    assert got.rdd.getNumPartitions() == -(-402 // 30)
    found = sorted(map(tuple, got.collect()))
    with monkeypatch.context() as m:
        m.setattr(readers, "mounted", lambda *a: None)
        assert found == sorted(map(tuple, readers.read_labelled_text_dirs(spark, str(root)).collect()))
    assert len(found) == 1 + sum(k % 3 < 2 and k % 7 > 0 for k in range(400))
    assert all(text.startswith("té\n") for _, _, text in found if text[0] == "t")
    (tmp_path / "empty").mkdir()
    assert readers.read_labelled_text_dirs(spark, str(tmp_path / "empty")).count() == 0


def test_samples_may_be_spread_over_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"id": "1",\n  "body": "x"}\n]\n')
    assert [(r.id, r.body) for r in readers.read_eval_samples(spark, str(tmp_path)).collect()] == [("1", "x")]


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_ngram_totals_and_table_equal_plain_windows(spark, monkeypatch, at_once):
    """Counted some texts at a time, once for each different text; nothing runs again when a model reads the table."""
    monkeypatch.setattr(T, "AT_ONCE", at_once)
    texts = ["é\n\r x" * 50, "", None, "x", "ab", "abcabc", "\x00\x00\x00", "code 1", "code 1"] * 3
    rows = spark.createDataFrame([(t, ("AD", "FRAUD", "NEEDS_REVIEW")[k % 3], k) for k, t in enumerate(texts)], "text string, label string, k long").coalesce(2)
    wanted = {}
    for t in texts:
        for gram in windows((t or "").encode()):
            wanted[gram] = wanted.get(gram, 0) + 1
    totals = T.ngram_totals(rows, "text")
    assert dict(map(tuple, totals.collect())) == wanted
    words = totals.orderBy(F.desc("n"), "gram").limit(20).persist()
    names, table = [r.gram for r in words.collect()], candidates.ngram_table(rows, words)
    got = {r.k: (r.text, r.label_index, r.features) for r in table.collect()}
    assert sorted(got) == [k for k in range(len(texts)) if k % 3 < 2] and "MapInArrow" not in table._jdf.queryExecution().executedPlan().toString()
    for k, (text, at, features) in got.items():
        held = windows((text or "").encode())
        assert text == texts[k] and at == LABELS.index(("AD", "FRAUD")[k % 3]) and features.toArray().tolist() == [held.count(g) for g in names]
    assert candidates.ngram_table(rows, words.limit(0)).count() == len(got)


def test_equal_rows_are_fitted_once_with_their_number(spark):
    rows = spark.createDataFrame([("win now", "FRAUD")] * 30 + [("sale", "AD")] * 5 + [("sale", "FRAUD"), ("x", "HARASS")], "text string, label string")
    model, table = candidates.train_ngram_logistic(rows, T.ngram_totals(rows, "text").limit(10), iterations=5)
    assert sorted((r.text, r.label, r.weight) for r in table.collect()) == [("sale", "AD", 5), ("sale", "FRAUD", 1), ("win now", "FRAUD", 30), ("x", "HARASS", 1)]
    assert model.summary.totalIterations > 0


def test_rules_run_only_on_texts_that_can_match(spark):
    """The same ids as every expression on every text gives, whatever the case and script; few expressions run on a plain text."""
    odd = classify.Rule("X", "en", "AD_HINT", 1, r"[0-9]{3}|\bfree\b", "AD", "SUSPECT", "X")
    rules = (*classify.RULES, odd, classify.Rule("Y", "en", "AD_HINT", 2, "STRASSE|Kelvin", "AD", "SUSPECT", "Y"))
    texts = ["VERIFICATION Code: 1234", "click", "Verify  immediately clIcK", "verİfy İmmedİately lİnk", "unſubſcribe", "Keep calling", "kelvin", "KELVIN 5", "验证码: 1234", "退订 td", "otp 123456", "ओटीपी 1234", "bit.ly/A", "", None, "123", "FREE", "x" * 5000, "Special\tOFFER", "transaction T.CO/9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.array_compact(F.array(*(F.when(F.col("t").rlike(f"(?iu){r.pattern}"), r.id) for r in classify.rules_by_priority(rules))))
    got = rows.select("t", classify.match_rules(F.col("t"), rules).alias("a"), every.alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(bool(r.b) for r in got) > 10
    tried = classify.match_rules(F.col("t"), (classify.Rule("Z", "en", "AD_HINT", 1, "(?:needle)[0-9]", "AD", "SUSPECT", "Z"),))
    assert "contains" in rows.select(tried)._jdf.queryExecution().optimizedPlan().toString().lower()
