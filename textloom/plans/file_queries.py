"""Queries over readers and sinks: rows of the given tables are written to the shared folder, read back and compared with the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.places import names_in, rename_parts, shared_folder
from textloom.plans.views import pieces, query, view
from textloom.sources import readers, writers


def records(spark, d):
    """Message records of the labelled rows; some fields missing."""
    rows = view(spark, d, "labelled")
    odd = F.col("msg_id") % 5 == 0
    return rows.select(
        "id", "text", "label", "language", F.when(~odd, F.col("source")).alias("source"), F.lit("l").alias("source_license"), "sender_group", "template_group",
        F.when(F.col("msg_id") % 10 < 8, "train").when(F.col("msg_id") % 10 == 8, "validation").otherwise("test").alias("split"), F.lit(False).alias("is_synthetic"), odd.alias("is_adversarial"),
        F.when(odd, F.col("id")).alias("parent_id"), F.array(F.lit("a")).alias("annotator_ids"),
    )


SQL = "SELECT id, text, label, language, CASE WHEN msg_id % 5 = 0 THEN '' ELSE source END AS source, msg_id % 5 = 0 AS is_adversarial, CASE WHEN msg_id % 5 = 0 THEN id END AS parent_id FROM labelled"
SEEN = ("id", "text", "label", "language", "source", "is_adversarial", "parent_id")


@query("write_messages_jsonl", SQL, "labelled")
def write_messages_jsonl(spark, d):
    """What the sink wrote, read as plain JSON."""
    folder = shared_folder(spark, "jsonl")
    writers.write_messages_jsonl(records(spark, d), folder)
    rows = spark.read.schema("id string, text string, label string, language string, source string, is_adversarial boolean, parent_id string").json(folder)
    return rows.withColumn("source", F.coalesce("source", F.lit("")))


@query("read_messages_jsonl", SQL, "labelled")
def read_messages_jsonl(spark, d):
    folder = shared_folder(spark, "jsonl")
    records(spark, d).select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.range(3).select(F.lit("  ").alias("value"))).write.text(folder)
    return readers.read_messages_jsonl(spark, folder).select(*SEEN)


@query("read_raw_dir", SQL, "labelled")
def read_raw_dir(spark, d):
    folder = shared_folder(spark, "raw-dir")
    records(spark, d).select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    rename_parts(spark, folder, ".jsonl")
    return readers.read_raw_dir(spark, folder).select(*SEEN)


@query("sample_texts", "SELECT text FROM labelled", "labelled")
def sample_texts(spark, d):
    folder = shared_folder(spark, "jsonl")
    writers.write_messages_jsonl(records(spark, d), folder)
    return readers.sample_texts(spark, folder)


@query("read_split_dir", "SELECT id, CASE WHEN msg_id % 10 < 8 THEN 'train' WHEN msg_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM labelled", "labelled")
def read_split_dir(spark, d):
    folder, rows = shared_folder(spark, "split-dir"), records(spark, d)
    for split in ("train", "validation", "test"):
        writers.write_messages_jsonl(rows.filter(F.col("split") == split).withColumn("split", F.lit("elsewhere")), f"{folder}/{split}.jsonl")
    return readers.read_split_dir(spark, folder).select("id", "split")


@query("write_splits_gated", "SELECT id, CASE WHEN msg_id % 10 < 8 THEN 'train' WHEN msg_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM labelled", "labelled")
def write_splits_gated(spark, d):
    """Splits without a leak: groups of their own for each row; read back by partition."""
    folder = shared_folder(spark, "splits")
    rows = records(spark, d).withColumn("template_group", F.col("id")).withColumn("sender_group", F.col("id")).withColumn("parent_id", F.lit(None).cast("string"))
    writers.write_splits_gated(rows, folder)
    return spark.read.schema("id string, split string").json(folder).select("id", "split")


PACK = "SELECT id, text || chr(10) || '\"said\", ' || label AS text, label, orig_label, annotator, notes FROM annotations"


def pack(spark, d):
    return view(spark, d, "annotations").select("id", F.concat("text", F.lit('\n"said", '), "label").alias("text"), "label", "orig_label", "annotator", "notes")


@query("write_annotation_csv", PACK, "annotations")
def write_annotation_csv(spark, d):
    """What the sink wrote, read by Spark's own CSV reader."""
    folder = shared_folder(spark, "pack")
    writers.write_annotation_csv(pack(spark, d), folder)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("id", "text", "label", "orig_label", "annotator", "notes")))


@query("read_annotation_csv", PACK, "annotations")
def read_annotation_csv(spark, d):
    folder = shared_folder(spark, "pack")
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    pack(spark, d).withColumnRenamed("orig_label", "uci_binary").write.option("header", True).option("escape", '"').options(**blanks).csv(folder)
    return readers.read_annotation_csv(spark, folder).select("id", "text", "label", "orig_label", "annotator", "notes")


@query("read_csv_encoding_fallback", "SELECT id, CASE hash % 3 WHEN 0 THEN '验证码' || id || '您好' WHEN 1 THEN 'é𠀀' || id ELSE '验证码' || id || chr(10) || 'ü' END AS text FROM (SELECT id, length(id) + ascii(right(id, 1)) AS hash FROM annotations)", "annotations")
def read_csv_encoding_fallback(spark, d):
    """A folder of packs in GBK, GB18030 and UTF-8: each file is read in the encoding that reads all of it."""
    folder, kind = shared_folder(spark, "mixed"), (F.length("id") + F.ascii(F.right("id", F.lit(1)))) % 3
    texts = (("GBK", F.concat(F.lit("验证码"), "id", F.lit("您好"))), ("GB18030", F.concat(F.lit("é𠀀"), "id")), ("UTF-8", F.concat(F.lit("验证码"), "id", F.lit("\nü"))))
    with readers.java_charsets(spark):
        for k, (name, text) in enumerate(texts):
            view(spark, d, "annotations").filter(kind == k).select("id", text.alias("text")).write.mode("append").option("header", True).option("encoding", name).csv(folder)
    return readers.read_csv_encoding_fallback(spark, folder).select("id", "text")


def in_order(spark, rows, key: str, n: int):
    """``rows`` in the order of ``key`` from the first partition to the last, sorted and stored in ``n`` parts.

    Whoever reads them through one task, for one file, sorts nothing there and holds a batch of rows at a time.
    """
    folder = shared_folder(spark, "in-order")
    rows.repartitionByRange(n, key).sortWithinPartitions(key).write.parquet(folder)
    parts = sorted(name for name in names_in(spark, folder) if name.startswith("part-"))
    return reduce(DataFrame.union, (spark.read.schema(rows.schema).parquet(f"{folder}/{part}") for part in parts))


@query("bad_message_lines", "SELECT (row_number() OVER (ORDER BY o_orderkey)) * 3 - 1 AS line, '{' || o_orderkey AS text FROM orders")
def bad_message_lines(spark, d):
    """One file of orders, for each a good line, a bad one and a blank one: the numbers of the bad lines."""
    folder, key = shared_folder(spark, "bad"), F.col("o_orderkey").cast("string")
    good = F.to_json(F.struct(key.alias("id"), F.lit("t").alias("text")))
    lines = view(spark, d, "orders").select("o_orderkey", F.concat_ws("\n", good, F.concat(F.lit("{"), key), F.lit(" ")).alias("value"))
    in_order(spark, lines, "o_orderkey", pieces(spark, f"{d}/orders.parquet", 8 << 20)).select("value").coalesce(1).write.text(folder)
    return readers.bad_lines(spark, folder).select("line", "text")


@query("read_corrections", "SELECT id, old, new, reason, 'fix_' || k % 3 AS source, CASE k % 3 WHEN 0 THEN 80 WHEN 1 THEN 50 ELSE 0 END AS priority FROM (SELECT id, label AS old, 'FRAUD' AS new, 'r' || msg_id AS reason, msg_id AS k FROM labelled WHERE msg_id % 5 = 0)", "labelled")
def read_corrections(spark, d):
    """Changes in files of three names, two of which have a priority."""
    folder, rows = shared_folder(spark, "corrections"), view(spark, d, "labelled").filter("msg_id % 5 = 0")
    change = F.struct("id", F.col("label").alias("old"), F.lit("FRAUD").alias("new"), F.concat(F.lit("r"), F.col("msg_id").cast("string")).alias("reason"))
    for k in range(3):
        part = f"{folder}/fix_{k}"
        rows.filter(F.col("msg_id") % 3 == k).agg(F.collect_list(change).alias("changes")).coalesce(1).write.json(part)
        rename_parts(spark, part, ".json", f"fix_{k}")
    return readers.read_corrections(spark, f"{folder}/*/*.json", {"fix_0": 80, "fix_1": 50}).select("id", "old", "new", "reason", "source", "priority")


@query("read_labelled_text_dirs", "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'spam' ELSE 'ham' END AS label, 'Dear ' || c_name AS text FROM customer WHERE c_custkey % 4 < 3")
def read_labelled_text_dirs(spark, d):
    """A message to each customer, a file each, in folders named by label, those of ten thousand customers in one of their own;
    the folder of another name is left out."""
    folder, key = shared_folder(spark, "text-dirs"), F.col("c_custkey") % 4
    label = F.when(key == 0, "spam").when(key == 3, "other").otherwise("ham")
    rows = view(spark, d, "customer").select(F.floor(F.col("c_custkey") / 10_000).alias("part"), label.alias("label"), F.col("c_custkey").alias("name"), F.concat(F.lit("  Dear "), "c_name", F.lit(" ")).alias("text"))
    writers.write_labelled_text_dirs(rows, folder)
    return readers.read_labelled_text_dirs(spark, folder).select("label", "text")


@query("read_labelled_tsv", "SELECT CASE WHEN msg_id % 3 = 0 THEN 'spam' ELSE 'ham' END AS label, trim(body) AS text FROM messages WHERE msg_id % 11 <> 0", "messages")
def read_labelled_tsv(spark, d):
    folder, key = shared_folder(spark, "tsv"), F.col("msg_id")
    label = F.when(key % 11 == 0, "other").when(key % 3 == 0, "spam").otherwise("ham")
    view(spark, d, "messages").select(F.concat(label, F.lit("\t"), "body").alias("value")).write.text(folder)
    return readers.read_labelled_tsv(spark, folder, ("ham", "spam"))


@query("read_eval_samples", "SELECT id, sender, body, label AS expected_category FROM (SELECT 'e' || m.msg_id AS id, m.sender, trim(m.body) AS body, l.label FROM messages m JOIN labelled l ON m.msg_id = l.msg_id)", "messages", "labelled")
def read_eval_samples(spark, d):
    """Samples in files of some two hundred, every other file an object with ``samples``."""
    rows = view(spark, d, "messages").join(view(spark, d, "labelled").select("msg_id", "label"), "msg_id")
    even = F.col("msg_id") % 2 == 0
    sample = F.struct(F.concat(F.lit("e"), F.col("msg_id").cast("string")).alias("id"), "sender", F.when(even, F.col("body")).alias("body"), F.when(~even, F.col("body")).alias("text"), F.when(even, F.col("label")).alias("expectedCategory"), F.when(~even, F.col("label")).alias("label"))
    files = rows.groupBy(F.floor(F.col("msg_id") / 800).alias("file")).agg(F.collect_list(sample).alias("samples"))
    value = F.when(F.col("file") % 2 == 0, F.to_json("samples")).otherwise(F.to_json(F.struct("samples")))
    folder = shared_folder(spark, "samples")
    files.select("file", value.alias("value")).write.partitionBy("file").text(folder)
    return readers.read_eval_samples(spark, f"{folder}/*/*.txt").select("id", "sender", "body", "expected_category")
