"""Exact deduplication by content-defined chunk recipes.

Every text is cut into content-defined chunks where it lies. Distinct chunks, known by a 64-bit hash and a length and
verified by their SHA-256, are numbered in a table. A text's recipe is the ordered list of its chunks' numbers, and texts are
compared by recipe: a few bytes for each chunk are shuffled, the texts themselves never.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import Scratch, read, text_of, with_groups

WHITE = b" \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(data: bytes, bits: int = 11, least: int = 256, most: int = 16_384) -> list[int]:
    """Ends of the content-defined chunks of ``data``.

    A chunk ends after each 8 bytes whose hash has ``bits`` leading zero bits, but holds ``least`` bytes at least and
    ``most`` at most. The last chunk may be shorter.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    windows = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    cuts = np.flatnonzero((windows * _MIX) >> np.uint64(64 - bits) == 0) + 8
    ends, last = [], 0
    while n - last > least:
        at = np.searchsorted(cuts, last + least)
        end = min(int(cuts[at]) if at < len(cuts) else n, last + most, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, hashes, sizes, checks, whole = [0], [], [], [], []
        for text in batch["text"].cast(pa.binary()).to_pylist():
            normal, start = text.translate(None, WHITE), 0
            for end in chunk_ends(normal):
                chunk = normal[start:end]
                hashes.append(xxhash.xxh3_64_intdigest(chunk))
                sizes.append(end - start)
                checks.append(hashlib.sha256(chunk).digest())
                start = end
            ends.append(len(sizes))
            whole.append(hashlib.sha256(normal).digest())
        found = pa.StructArray.from_arrays([pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(checks, pa.binary())], names=["hash", "bytes", "check"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_chars"], pa.array(whole, pa.binary()), lists], names=["doc_id", "n_chars", "sha", "chunks"])


def chunked_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, sha, chunks) for each row; chunks lists (hash, bytes, check) of the text without white space, in order."""
    rows = documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("n_chars", F.char_length("text"))
    return rows.mapInArrow(_chunks, "doc_id long, n_chars int, sha binary, chunks array<struct<hash:bigint,bytes:int,check:binary>>")


def text_recipes(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, n_chars, sha, recipe) for each row of ``documents``; equal recipes are equal texts without white space."""
    # A written table fixes the row numbers and spares a second pass over the texts.
    rows = scratch.table(chunked_texts(documents).withColumn("row", F.monotonically_increasing_id()), "chunked")
    uses = rows.select("row", F.posexplode("chunks").alias("at", "chunk")).select("row", "at", "chunk.*")
    key = ["hash", "bytes", "check"]
    # Map-side combine leaves a row for each chunk and task, however often a chunk is used.
    table = scratch.table(uses.groupBy(*key).agg(F.count("*").alias("uses")).withColumn("number", F.monotonically_increasing_id()), "chunk_table")
    ordered = F.array_sort(F.collect_list(F.struct("at", "number")))
    recipes = with_groups(uses, table, key, "uses").groupBy("row").agg(F.transform(ordered, lambda c: c["number"]).alias("recipe"))
    none = F.array().cast("array<bigint>")
    out = rows.select("row", "doc_id", "n_chars", "sha").join(recipes, "row", "left").withColumn("recipe", F.coalesce("recipe", none))
    return scratch.table(out, "recipes")


def exact_dedup(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): which row of its group of equal texts stays.

    Texts are equal if they are identical without white space. The row with the most code points stays, then the
    smallest doc_id (null last), then one of the rows that still tie. Null and empty texts are one group, with an empty
    recipe. An empty table gives an empty result. Columns of other names are ignored.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    rows = text_recipes(documents, scratch)
    scratch.drop("chunked", "chunk_table")
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    groups = rows.groupBy("recipe").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    groups = groups.select("recipe", "n", F.col("n").alias("group_size"), F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    joined = with_groups(rows, scratch.table(groups, "groups"), ["recipe"], "n", "left")
    alone = F.col("keep_row").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM w
"""
