"""Readers of messages, annotation packs, corrections and rules. Missing text fields become empty strings."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.places import mounted, shared_folder
from textloom.schema import ANNOTATION_FIELDS, MESSAGE, SPLITS

BAD = "_corrupt_record"


def read_messages_jsonl(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Message records, a JSON object a line; blank lines are skipped. Bad lines raise, or are kept in ``_corrupt_record``.

    Rows carry ``_file`` so that "first" can mean file order.
    """
    schema = T.StructType([*MESSAGE.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("_file", F.col("_metadata.file_path"))
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"), "_file").select("r.*", "_file")
    columns = [F.coalesce(f.name, F.lit("")).alias(f.name) if f.dataType == T.StringType() and f.name != "parent_id" else F.coalesce(f.name, F.lit(False)).alias(f.name) if f.dataType == T.BooleanType() else F.col(f.name) for f in MESSAGE.fields]
    checked = F.when(F.col(BAD).isNotNull(), F.raise_error(F.concat(F.lit("bad line in "), F.col("_file"), F.lit(": "), F.col(BAD)))) if strict else F.col(BAD)
    out = rows.select(*columns, checked.cast("string").alias(BAD), "_file")
    return out.filter(F.col(BAD).isNull()).drop(BAD) if strict else out


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, text): lines of JSON lines files that are no message record, lines counted from 1, blank ones too.

    Spark reads long files in pieces. One pass counts the lines of each piece and notes bad ones by their place in it; the
    counts of the pieces before, a row for each piece, then give the line in the file.
    """
    schema = T.StructType([*MESSAGE.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"))
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    marked = lines.select("file", "piece", F.when((F.trim("value") != "") & parsed[BAD].isNotNull(), F.col("value")).alias("bad"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            out = []
            for file, piece, bad in zip(*(batch[c].to_pylist() for c in ("file", "piece", "bad")), strict=True):
                if (file, piece) != now:
                    if now:
                        out.append((*now, n, None))
                    now, n = (file, piece), 0
                n += 1
                if bad is not None:
                    out.append((file, piece, n, bad))
            yield _pieces(out)
        if now:
            yield _pieces([(*now, n, None)])

    folder = shared_folder(spark, "bad-lines")
    marked.mapInArrow(counted, "file string, piece long, n long, bad string").write.parquet(folder)
    found = spark.read.schema("file string, piece long, n long, bad string").parquet(folder)
    upto = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = found.filter("bad IS NULL").select("file", "piece", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return found.filter("bad IS NOT NULL").join(before, ["file", "piece"]).select("file", (F.col("before") + F.col("n")).alias("line"), F.col("bad").alias("text"))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "piece", "n", "bad"])


def checked_messages_jsonl(spark: SparkSession, path: str | list[str], shown: int = 5) -> DataFrame:
    """Message records, after a pass that finds bad lines: an error names the first of them as file:line."""
    bad = bad_lines(spark, path).orderBy("file", "line").limit(shown).collect()
    if bad:
        raise ValueError("bad lines: " + "; ".join(f"{r['file']}:{r['line']}: {r['text'][:100]}" for r in bad))
    return read_messages_jsonl(spark, path)


def read_raw_dir(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.jsonl`` of a folder."""
    return read_messages_jsonl(spark, f"{folder.rstrip('/')}/*.jsonl")


def sample_texts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    texts = read_messages_jsonl(spark, path).select("text")
    return texts if limit is None else texts.limit(limit)


def read_split_dir(spark: SparkSession, folder: str) -> DataFrame:
    """train, validation and test files; the file's name is the split, whatever the rows say."""
    out = None
    for split in SPLITS:
        rows = read_messages_jsonl(spark, f"{folder.rstrip('/')}/{split}.jsonl").withColumn("split", F.lit(split))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_annotation_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Annotation rows with a header; a byte order mark is dropped, columns that are missing are empty."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip('"') for c in rows.columns))
    for old in ("uci_binary", "binary_label"):
        if old in rows.columns and "orig_label" not in rows.columns:
            rows = rows.withColumnRenamed(old, "orig_label")
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in ANNOTATION_FIELDS))


#: Encodings in the order in which they are tried, by Python's names, with those of Java.
ENCODINGS = {"utf-8": "UTF-8", "gbk": "GBK", "gb18030": "GB18030"}


def file_encodings(spark: SparkSession, path: str | list[str], encodings: Sequence[str] = tuple(ENCODINGS)) -> DataFrame:
    """(file, encoding): for each file the first encoding that reads every byte of it, null if none does.

    Lines come as bytes, cut at line feeds, which are no part of a character in any of these encodings, so long files are
    read in pieces. Each line is decoded strictly; of a file's lines only the bits that say who can read them are brought together.
    """

    def readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for line in batch["line"].to_pylist():
                found = 0
                for k, name in enumerate(encodings):
                    try:
                        line.decode(name)
                        found |= 1 << k
                    except UnicodeDecodeError:
                        pass
                bits.append(found)
            yield pa.RecordBatch.from_arrays([batch["file"], pa.array(bits, pa.int32())], names=["file", "bits"])

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    bits = lines.mapInArrow(readable, "file string, bits int").groupBy("file").agg(F.expr("bit_and(bits)").alias("bits"))
    first = F.coalesce(*(F.when(F.col("bits").bitwiseAND(1 << k) > 0, name) for k, name in enumerate(encodings)))
    return bits.select("file", first.alias("encoding"))


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """In this context Spark takes all charsets of Java, GBK and its kin too."""
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def read_csv_encoding_fallback(spark: SparkSession, path: str | list[str], encodings: Sequence[str] = tuple(ENCODINGS)) -> DataFrame:
    """Annotation rows of files each in an encoding of its own; a file that none of ``encodings`` reads is an error.

    The driver learns one name a file. Files in UTF-8 are read as they are, the others once into the shared folder.
    """
    found: dict[str, list[str]] = {}
    for row in file_encodings(spark, path, encodings).toLocalIterator():
        found.setdefault(row["encoding"], []).append(row["file"])
    if None in found:
        raise ValueError(f"no encoding of {', '.join(encodings)} reads {', '.join(sorted(found[None])[:5])}")
    parts = []
    for name, files in sorted(found.items()):
        if name == "utf-8":
            parts.append(read_annotation_csv(spark, files))
            continue
        with java_charsets(spark):
            folder = shared_folder(spark, "decoded")
            rows = read_annotation_csv(spark, files, ENCODINGS.get(name, name))
            rows.write.parquet(folder)
        parts.append(spark.read.schema(rows.schema).parquet(folder))
    return reduce(DataFrame.unionByName, parts) if parts else read_annotation_csv(spark, path)


def read_labelled_tsv(spark: SparkSession, path: str, labels: Sequence[str], blank_separated: bool = False) -> DataFrame:
    """(label, text) of lines ``label<TAB>text``; lines without a known label or a text are dropped."""
    line = F.trim("value")
    parts = F.split(line, "\t", 2)
    if blank_separated:
        parts = F.when(F.contains("value", F.lit("\t")), parts).otherwise(F.split(line, r"\s+", 2))
    rows = spark.read.text(path).select(F.trim(F.get(parts, F.lit(0))).alias("label"), F.trim(F.get(parts, F.lit(1))).alias("text"))
    return rows.filter(F.col("label").isin(*labels) & (F.col("text") != ""))


#: What is dropped at both ends of a text that has a file of its own, as Python's ``strip`` does.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Files that one task reads.
FILES_AT_ONCE = 20_000
_FILE = pa.schema([(c, pa.string()) for c in ("file", "label", "value")])
_ENTRY = "folder string, name string, is_folder boolean"


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name) of all ``*.txt`` below ``root``, a folder of a mounted file system; hidden ones are left out as Spark does.

    Folders are listed in tasks, one level after the other, and names go from there to a table: the driver sees none.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for above, inner in zip(batch["folder"].to_pylist(), batch["name"].to_pylist(), strict=True):
                folder, out = os.path.join(above, inner), []
                with os.scandir(folder) as entries:
                    for entry in entries:
                        hidden = entry.name.startswith((".", "_")) and not (entry.name.startswith("_") and "=" in entry.name)
                        if not hidden and ((inside := entry.is_dir()) or entry.name.endswith(".txt")):
                            out.append((folder, entry.name, inside))
                        if len(out) == 10_000:
                            yield _entries(out)
                            out = []
                yield _entries(out)

    table, level, found = shared_folder(spark, "text-files"), 0, spark.createDataFrame([(root.rstrip("/") or "/", "", True)], _ENTRY)
    while n := found.count():
        dealt = found.repartition(min(n, 8 * spark.sparkContext.defaultParallelism))
        dealt.select("folder", "name").mapInArrow(listed, _ENTRY).write.parquet(f"{table}/level={level}")
        found = spark.read.schema(_ENTRY).parquet(f"{table}/level={level}").filter("is_folder")
        level += 1
    return spark.read.schema(_ENTRY).parquet(*(f"{table}/level={k}" for k in range(level))).filter("NOT is_folder").select("folder", "name")


def _uri(path: str) -> str:
    """A path as Spark names it: only what no URI may hold is escaped."""
    return "file:" + re.sub(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=/@\x80-\U0010ffff]|[\x80-\xa0\s]", lambda m: quote(m[0]), path)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()), strict=True)], names=["folder", "name", "is_folder"])


def read_labelled_text_dirs(spark: SparkSession, folder: str, labels: Sequence[str] = ("ham", "spam")) -> DataFrame:
    """(file, label, text): a message a file, labelled by its folder.

    On a mounted file system tasks list the folders and read the files, ``FILES_AT_ONCE`` each, so that neither the driver's
    memory nor the number of tasks follows the files. Elsewhere Spark's reader lists them.
    """
    root, schema = mounted(spark, folder), "file string, label string, value string"
    if root is None:
        rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
        path = F.col("_metadata.file_path")
        rows = rows.select(path.alias("file"), F.element_at(F.split(path, "/"), -2).alias("label"), "value")
    else:

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, size = [], 0
                for above, name in zip(batch["folder"].to_pylist(), batch["name"].to_pylist(), strict=True):
                    above = above.rstrip("/")
                    with open(f"{above}/{name}", "rb") as file:
                        text = file.read().decode(errors="replace")
                    out.append((_uri(f"{above}/{name}"), above.rsplit("/", 1)[-1], text))
                    if (size := size + len(text)) > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(("file", "label", "value"), row, strict=True)) for row in out], _FILE)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "label", "value"), row, strict=True)) for row in out], _FILE)

        files = text_files(spark, root)
        rows = files.repartition(max(spark.sparkContext.defaultParallelism, -(-files.count() // FILES_AT_ONCE))).mapInArrow(opened, schema)
    return rows.select("file", "label", F.trim("value", F.lit(BLANKS)).alias("text")).filter(F.col("label").isin(*labels) & (F.col("text") != ""))


def read_vendor_corpus(rows: DataFrame, text: Sequence[str], label: Sequence[str], recode: Mapping[str, str]) -> DataFrame:
    """(text, label) from whichever of the candidate columns a vendor's table has, labels recoded."""

    def first_of(names: Sequence[str]) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in rows.columns), F.lit(""))

    raw = F.lower(first_of(label))
    code = F.create_map(*(F.lit(x) for kv in recode.items() for x in kv))[raw]
    return rows.select(first_of(text).alias("text"), F.coalesce(code, raw).alias("label")).filter("text <> ''")


def weak_candidates(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Vendor candidates to keep, and how many rows each reason excluded: status, empty text, repeated text."""
    from textloom.operators.dedupe import first_per

    text = F.trim(F.coalesce("sms_text", F.lit("")))
    marked = rows.drop("sender").withColumn("reason", F.when(F.coalesce("classification_status", F.lit("")) != "success", "status").when(text == "", "empty"))
    good = marked.filter("reason IS NULL").drop("reason")
    kept = first_per(good, F.trim("sms_text"), order)
    reasons = marked.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))
    again = kept.agg(F.lit("kept").alias("reason"), F.count("*").alias("n"))
    return kept, reasons.union(again)


def read_rules(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Enabled rules of JSON files {version, rules: [...]}, defaults filled in."""
    schema = "version string, rules array<struct<id string, language string, type string, priority int, pattern string, categoryHint string, action string, reasonCode string, enabled boolean>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.coalesce("version", F.lit("1.0.0")).alias("version"), F.explode("rules").alias("r")).select("version", "r.*")
    filled = {"language": "unknown", "priority": 0, "reasonCode": "RULE_MATCH", "enabled": True}
    return rows.select(*(F.coalesce(c, F.lit(filled[c])).alias(c) if c in filled else F.col(c) for c in rows.columns)).filter("enabled")


def rules_of(table: DataFrame) -> tuple:
    """A rule table, a few rows by its nature, as rules for ``match_rules``."""
    from textloom.operators.classify import Rule

    return tuple(Rule(r["id"], r["language"], r["type"], r["priority"], r["pattern"], r["categoryHint"], r["action"], r["reasonCode"]) for r in table.toLocalIterator())


def read_corrections(spark: SparkSession, path: str | list[str], priorities: Mapping[str, int]) -> DataFrame:
    """Changes of JSON files {changes: [...]}; the file's name is the source and gives the priority."""
    schema = "changes array<struct<id string, old string, new string, reason string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    source = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.json)?$", 1)
    rows = rows.select(source.alias("source"), F.posexplode("changes").alias("seq", "c")).select("c.*", "source", F.col("seq").cast("long").alias("seq"))
    known = F.create_map(*(F.lit(x) for kv in priorities.items() for x in kv)) if priorities else F.create_map()
    return rows.withColumn("priority", F.coalesce(known[F.col("source")], F.lit(0)))


def read_words(spark: SparkSession, path: str | list[str]) -> tuple[str, ...]:
    """A word list, a word a line, for the cascades that take one; blank lines and repeats are left out, the order is by file and line."""
    rows = spark.read.text(path).select(F.trim("value").alias("word"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    return tuple(dict.fromkeys(r["word"] for r in rows.filter("word <> ''").orderBy("file", "n").toLocalIterator()))


def read_eval_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a JSON array or of an object with ``samples``; body or text, expectedCategory or label; blanks are null."""
    sample = "struct<id string, sender string, body string, text string, expectedCategory string, label string, expectedAction string>"
    whole = spark.read.text(path, wholetext=True)
    both = F.coalesce(F.from_json("value", f"struct<samples array<{sample}>>")["samples"], F.from_json("value", f"array<{sample}>"))
    rows = whole.select(F.posexplode(both).alias("i", "s")).select("i", "s.*")

    def given(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))

    return rows.select(F.coalesce(given("id"), F.concat(F.lit("eval-"), F.col("i").cast("string"))).alias("id"), given("sender").alias("sender"), given("body", "text").alias("body"), given("expectedCategory", "label").alias("expected_category"), given("expectedAction").alias("expected_action"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    schema = "sources array<struct<id string, license string, languages array<string>, labels array<string>, is_synthetic boolean, approved_for_git boolean, sha256 string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("sources").alias("s")).select("s.*")
