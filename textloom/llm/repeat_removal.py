"""Removal of long byte strings that occur more than once, within or across documents.

The result is that of a suffix array over all documents: every byte that lies in a 400-byte string which also starts
somewhere else goes. How it is found at scale, and why not by inserting one symbol per document and round into a
Burrows-Wheeler transform, is in the README: the longest document sets the number of rounds.

1. Each 400-byte window is named by its minimizer, the leftmost 200-byte gram with the least hash. Equal windows have
   equal minimizers at the same offset, so windows with a minimizer that occurs once are unique. Neighbouring windows
   share a minimizer; such a run is one row, about one for 100 bytes.
2. Runs of one minimizer with equal contents are copies of each other as a whole.
3. What is left are different runs around one minimizer. One run of each content is looked at window by window: 16
   neighbouring windows have 385 bytes in common, and only where these occur in two contents are the windows compared.

Every step is an aggregation by hash or a join with one row for each key on one side; no pairs are listed, so groups of any
size stay linear, and a minimizer that very many documents share stays where its rows are. Windows are compared within one
minimizer only, so 128 bits decide: the hash of the minimizer's bytes and that of the window or run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import Scratch, read, text_of, with_groups
from textloom.llm.rolling import Rolling, mixed, window_runs

SLICE = 1 << 19
STEP = 16


def _keyed(documents: DataFrame) -> DataFrame:
    """Documents by (doc_id, k): equal rows share a key, which changes no result."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return (left["k"] == right["of_k"]) & left["doc_id"].eqNullSafe(right["of_doc"])


def _runs_of(window: int, gram: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[] for _ in range(7)]
            for doc_id, k, text in zip(batch["doc_id"].to_pylist(), batch["k"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                data = np.frombuffer(text, dtype=np.uint8)
                for start in range(0, max(0, len(data) - window + 1), SLICE):
                    first, count, at, anchor, run = window_runs(data[start : start + SLICE + window - 1], window, gram)
                    for column, values in zip(found, (None, None, first + start, count, at, anchor.view(np.int64), run.view(np.int64)), strict=True):
                        if values is not None:
                            column.append(values)
                    found[0].append((doc_id, len(first)))
                    found[1].append(np.full(len(first), k, dtype=np.int64))
            if found[0]:
                ids = pa.concat_arrays([pa.repeat(pa.scalar(d, pa.int64()), n) for d, n in found[0]])
                k, lo, n, at, anchor, run = (np.concatenate(x) for x in found[1:])
                yield pa.RecordBatch.from_arrays([ids, pa.array(k), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(anchor), pa.array(run)], names=["doc_id", "k", "lo", "n", "at", "anchor", "run"])

    return runs


def _blocks_of(window: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["runs"].to_pylist(), strict=True):
                data = np.frombuffer(text, dtype=np.uint8)
                for r in runs:
                    own = Rolling(data[r["lo"] : r["lo"] + r["n"] + window - 1])
                    salt = mixed(np.array([r["anchor"]], dtype=np.int64).view(np.uint64))
                    windows = mixed(own.at(np.arange(r["n"]), window) ^ salt)
                    offsets = r["at"] - np.arange(r["n"])  # from a window's start to the minimizer, falling
                    for sub in range(int(offsets[-1]) // STEP, int(offsets[0]) // STEP + 1):
                        low, high = max(r["at"] - STEP * sub - STEP + 1, 0), min(r["at"] - STEP * sub, r["n"] - 1)
                        core = mixed(own.at(np.array([r["at"] - STEP * sub]), window - STEP + 1) ^ salt ^ np.uint64(sub + 1))
                        rows.append((r["anchor"], r["run"], int(core.view(np.int64)[0]), r["lo"] + low, windows[low : high + 1].view(np.int64)))
            if rows:
                anchor, run, core, first, keys = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(run, pa.int64()), pa.array(core, pa.int64()), pa.array(first, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["anchor", "run", "core", "first", "keys"])

    return blocks


def repeated_spans(documents: DataFrame, scratch: Scratch, window: int = 400, gram: int = 200) -> DataFrame:
    """(of_doc, of_k, spans): for each document the byte ranges of windows that also start elsewhere; they may overlap."""
    docs = _keyed(documents)
    runs = scratch.table(docs.mapInArrow(_runs_of(window, gram), "doc_id long, k long, lo int, n int, at int, anchor long, run long"), "runs")
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("rows"), F.min("run").alias("low"), F.max("run").alias("high")).filter("rows > 1")
    anchors = scratch.table(anchors.select("anchor", "rows", (F.col("low") == F.col("high")).alias("alike")), "anchors")
    repeated = scratch.table(with_groups(runs, anchors, ["anchor"], "rows"), "repeated")
    scratch.drop("runs", "anchors")

    several = repeated.filter("not alike")
    place = F.struct("doc_id", "k", "lo", "n", "at")
    contents = scratch.table(several.groupBy("anchor", "run").agg(F.count("*").alias("rows"), F.min(place).alias("one")), "contents")
    looked_at = contents.groupBy(F.col("one.doc_id").alias("of_doc"), F.col("one.k").alias("of_k")).agg(F.collect_list(F.struct("one.lo", "one.n", "one.at", "anchor", "run")).alias("runs"))
    at_text = docs.join(looked_at, _same_document(docs, looked_at)).select("text", "runs")
    blocks = scratch.table(at_text.mapInArrow(_blocks_of(window), "anchor long, run long, core long, first int, keys array<long>"), "blocks")
    shared = blocks.groupBy("anchor", "core").agg(F.min("run").alias("low"), F.max("run").alias("high"), F.count("*").alias("rows")).filter("low <> high")
    shared = scratch.table(shared.select("anchor", "core", "rows"), "shared")
    windows = scratch.table(with_groups(blocks, shared, ["anchor", "core"], "rows").select("anchor", "run", "first", F.posexplode("keys").alias("step", "key")), "windows")
    scratch.drop("blocks", "shared")
    found = windows.groupBy("anchor", "key").agg(F.min("run").alias("low"), F.max("run").alias("high"), F.count("*").alias("rows")).filter("low <> high")
    found = scratch.table(found.select("anchor", "key", "rows"), "found")
    starts = with_groups(windows, found, ["anchor", "key"], "rows").groupBy("anchor", "run").agg(F.collect_set(F.col("first") + F.col("step")).alias("starts"))

    # A content's starts are bounded by the windows of one run, and a document's spans by its length.
    by_window = contents.filter("rows = 1").join(starts, ["anchor", "run"]).select("one.doc_id", "one.k", F.transform("starts", lambda s: F.struct(s.alias("s"), (s + window).alias("e"))).alias("spans"))
    copies = scratch.table(contents.filter("rows > 1").select("anchor", "run", "rows"), "copies")
    entire = repeated.filter("alike").drop("alike").unionByName(with_groups(several.drop("alike"), copies, ["anchor", "run"], "rows").select("anchor", *(c for c in several.columns if c not in ("anchor", "alike"))))
    entire = entire.select("doc_id", "k", F.array(F.struct(F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + window).alias("e"))).alias("spans"))
    return entire.unionByName(by_window).groupBy(F.col("doc_id").alias("of_doc"), F.col("k").alias("of_k")).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges covered by ``spans``."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, runs, kept = [], [], [], []
        for text, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["spans"].to_pylist(), strict=True):
            gone, at, parts = merged(spans), 0, []
            for s, e in gone:
                parts.append(text[at:s])
                at = e
            size.append(len(text))
            removed.append(sum(e - s for s, e in gone))
            runs.append(len(gone))
            kept.append(b"".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(documents: DataFrame, window: int = 400, gram: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``documents`` (doc_id, text).

    Bytes of the UTF-8 text that lie in a ``window``-byte string which also starts elsewhere, in the same document or
    another, are removed at once; strings are judged on the input. Matches never cross documents. kept holds the bytes
    left, which may cut a character. Null texts count as empty. Repeated rows are copies of each other, so both lose their
    windows. Texts shorter than ``window`` keep all. An empty table gives an empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    spans = scratch.table(repeated_spans(documents, scratch, window, gram), "spans")
    scratch.drop("repeated", "contents", "windows", "found", "copies")
    docs = _keyed(documents)
    joined = docs.join(spans, _same_document(docs, spans), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
