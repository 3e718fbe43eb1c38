"""SimHash near-duplicates: segment popcounts, a grid range join under a Manhattan bound, exact verification.

A fingerprint is embedded as the bit counts of 32 segments of 2 bits. Two fingerprints that differ in d bits lie at a
Manhattan distance of d at most, so a pair within 2 bits agrees on all but 2 of these coordinates. The grid takes the
coordinates in 8 axes of four; a cell is a choice of 6 axes and their values, so each pair within the bound shares one of
the 28 cells of each of its members. Cells of up to ``SMALL_CELL`` fingerprints are gathered, and each of their pairs is
verified by the bits in which it differs. Listing the pairs of larger cells would grow with the square of a cell; there the
verification is turned round: two fingerprints differ in 2 bits at most if and only if some centre lies within 1 bit of
both, so each member goes to its 65 centres and is linked to the least one there. Both ways are exact and lose no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import Scratch, numbered, read, text_of, with_groups
from textloom.llm.components import connected_components

SHINGLE = 3
SEED = 42
SMALL_CELL = 64


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the 3-word shingles of UTF-8 bytes, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white spaces only
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    firsts, ends = starts[: -SHINGLE].tolist(), (starts[SHINGLE:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(firsts, ends, strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):  # very long texts: bounded memory
        counts += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch["text"].cast(pa.binary()).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def _numbered_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch["text"].cast(pa.binary()).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(prints.view(np.int64))], names=["row", "doc_id", "print"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, print) for each row; print is the fingerprint as a signed long. Null text counts as empty."""
    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_fingerprints, "doc_id long, print long")


def grid_cells(prints: DataFrame) -> DataFrame:
    """(cell, print): the 28 cells of each fingerprint."""
    def axis(a: int):
        counts = [F.bit_count(F.shiftrightunsigned("print", 8 * a + 2 * k).bitwiseAND(3)).cast("long") * 3**k for k in range(4)]
        return counts[0] + counts[1] + counts[2] + counts[3]

    coordinates = prints.select("print", *(axis(a).alias(f"a{a}") for a in range(8)))

    def cell(number: int, chosen: tuple[int, ...]):
        value = F.lit(number).cast("long")
        for a in chosen:
            value = value * 81 + F.col(f"a{a}")
        return value

    return coordinates.select("print", F.explode(F.array(*(cell(k, c) for k, c in enumerate(combinations(range(8), 6))))).alias("cell"))


def fingerprint_links(prints: DataFrame, scratch: Scratch, small_cell: int = SMALL_CELL) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints at 2 or fewer differing bits.

    ``small_cell`` chooses between the two ways of verification, for cost only: any value gives the same components.
    """
    cells = grid_cells(prints.repartition("print"))
    shared = scratch.table(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").withColumn("members", F.col("n")), "cells")
    met = scratch.table(with_groups(cells, shared, ["cell"], "n"), "candidates")
    scratch.drop("cells")

    # Small cells: the members in an array, each pair of them compared.
    members = met.filter(F.col("members") <= small_cell).groupBy("cell").agg(F.array_sort(F.collect_list("print")).alias("p"))
    near = F.expr("flatten(transform(p, (u, i) -> transform(filter(slice(p, i + 2, size(p)), v -> bit_count(u ^ v) <= 2), v -> struct(u AS u, v AS v))))")
    links = members.select(F.explode(near).alias("l")).select("l.u", "l.v")

    # Large cells: a star to the least member about each centre.
    crowded = scratch.table(met.filter(F.col("members") > small_cell).select("print").distinct(), "crowded")
    flips = [F.col("print")] + [F.col("print").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)]
    spread = crowded.repartition("print").select("print", F.explode(F.array(*flips)).alias("centre"))
    stars = spread.groupBy("centre").agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low <> high").select("centre", "low")
    stars = spread.join(stars, "centre").filter("print <> low").select(F.col("print").alias("u"), F.col("low").alias("v"))  # 65 rows a centre at most
    return links.unionByName(stars).distinct()


def print_components(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (row, doc_id, print, ...) with first: (no_id, doc_id, row) of the row of its component with the smallest doc_id."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    least = scratch.table(rows.groupBy("print").agg(F.min(order).alias("least"), F.count("*").alias("n")), "distinct")
    component = connected_components(fingerprint_links(least.select("print"), scratch), scratch)
    # From fingerprints to the first document of their component: small tables, a row for each linked fingerprint.
    named = scratch.table(component.withColumnRenamed("node", "print").join(least.select("print", "least"), "print"), "named")
    smallest = scratch.table(named.groupBy("component").agg(F.min("least").alias("smallest"), F.count("*").alias("n")), "smallest")
    linked = with_groups(named.select("print", "component"), smallest, ["component"], "n").select("print", "smallest")
    by_print = least.join(linked, "print", "left").select("print", "n", F.coalesce("smallest", "least").alias("first"))
    return with_groups(rows, scratch.table(by_print, "by_print"), ["print"], "n")


def simhash_components(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``documents`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own included. Null and empty texts have
    fingerprint zero and are linked like any other. Repeated rows each get a row. A null doc_id is never the smallest
    unless its component has no other. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    rows = scratch.table(fingerprints(documents).withColumn("row", F.monotonically_increasing_id()), "prints")
    found = print_components(rows, scratch)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def near_dedup(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``documents`` with one row of each component left: the one with the smallest doc_id, of equal ids any one.

    Columns are unchanged, whatever their names. Null texts count as empty, and empty texts are near-duplicates of each
    other. Rows with a null doc_id stay only where their component has no row with one. Rows that repeat are one
    document. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    rows, row = numbered(documents, scratch, "numbered")
    known = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    prints = scratch.table(known.mapInArrow(_numbered_fingerprints, "row long, doc_id long, print long"), "prints")
    # Row numbers are unique, so this join is even whatever the groups are.
    dropped = print_components(prints, scratch).filter("first.row <> row").select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*documents.columns)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
