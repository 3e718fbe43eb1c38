"""Target-distribution importance resampling over hashed n-grams, bucketed by an Aho-Corasick dictionary.

Features are runs of one and two words; a feature's bucket is the CRC of its bytes. A task keeps a dictionary of the distinct
words it has met, each bounded by delimiters and carrying its CRC and length. The automaton over the dictionary scans a text
once and emits these payloads; a run of two words needs no string of its own, since the CRC of a whole follows from the CRCs
of its parts and the length of the last. Words the dictionary doesn't hold yet are found between the matches, get their
payload directly and are learnt, up to a bound; so the dictionary changes cost only, never a result.

Counts are one histogram of fixed width for each task, summed by Spark. The gains of the buckets are a broadcast of that fixed
width. Documents are scored where they lie; the draw ranks scores by ranges, so no task ranks all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._common import Scratch, read, text_of

BUCKETS = 10_000
DICTIONARY_WORDS = 1 << 16
#: Longer words are not learnt; it also bounds the table of shifts.
LONGEST_WORD = 63
#: A scan takes about so many bytes at once, whatever the length of a text.
BLOCK = 1 << 20

_DELIMITERS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_PLAIN = bytes(32 if b in _DELIMITERS else b + 32 if 65 <= b <= 90 else b for b in range(256))


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    """What one more zero byte makes of each low byte of a CRC."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return _byte_table()[c & np.uint32(255)] ^ (c >> np.uint32(8))


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[length, k, byte]: what ``length`` zero bytes make of a CRC whose k-th byte is ``byte``; lengths up to a longest word and a blank."""
    out = np.empty((LONGEST_WORD + 2, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(1, len(out)):
        out[k] = _zero_byte(out[k - 1])
    return out


def _applied(matrix: np.ndarray, c: int) -> int:
    out = 0
    for k in range(32):
        if c >> k & 1:
            out ^= int(matrix[k])
    return out


def _shift_long(c: int, length: int) -> int:
    """``length`` zero bytes appended to one CRC, by squaring the map of one byte."""
    matrix = _zero_byte(np.uint32(1) << np.arange(32, dtype=np.uint32))
    while length:
        if length & 1:
            c = _applied(matrix, c)
        matrix = np.array([_applied(matrix, int(m)) for m in matrix], dtype=np.uint32)
        length >>= 1
    return c


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of A + B from the CRC of A, and the CRC and length in bytes of B."""
    table, short = _shifts(), np.minimum(length, LONGEST_WORD + 1)
    moved = table[short, 0, first & np.uint32(255)] ^ table[short, 1, (first >> np.uint32(8)) & np.uint32(255)] ^ table[short, 2, (first >> np.uint32(16)) & np.uint32(255)] ^ table[short, 3, first >> np.uint32(24)]
    for at in np.flatnonzero(length > LONGEST_WORD + 1):
        moved[at] = _shift_long(int(first[at]), int(length[at]))
    return moved ^ second


class Dictionary:
    """Words with their payloads, and the automaton that finds them between delimiters."""

    def __init__(self, most_words: int = DICTIONARY_WORDS):
        self.most_words, self.words, self.automaton = most_words, {}, None
        self.crc, self.blank_crc, self.known = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32), 0

    def learn(self, words: list[bytes]) -> None:
        """Add words until the dictionary is full; the automaton is built again when it has doubled or is full."""
        for word in words:
            if len(self.words) >= self.most_words:
                break
            if len(word) <= LONGEST_WORD:
                self.words.setdefault(word, len(self.words))
        if len(self.words) >= max(64, 2 * self.known) or (len(self.words) >= self.most_words > self.known):
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for word, k in self.words.items():
                self.automaton.add_word(f" {word.decode('latin-1')} ", k)
            self.automaton.make_automaton()
            self.known = len(self.words)
            self.crc = np.fromiter((zlib.crc32(w) for w in self.words), dtype=np.uint32, count=self.known)
            self.blank_crc = np.fromiter((zlib.crc32(b" " + w) for w in self.words), dtype=np.uint32, count=self.known)

    def scan(self, plain: bytes) -> tuple[np.ndarray, ...]:
        """(start, length, crc, crc with a blank in front) of each word of a text that begins and ends with a blank."""
        filled = np.frombuffer(plain, dtype=np.uint8) != 32
        starts = np.flatnonzero(filled[1:] & ~filled[:-1]) + 1
        sizes = np.flatnonzero(filled[:-1] & ~filled[1:]) + 1 - starts
        crc, blank_crc = np.empty(len(starts), dtype=np.uint32), np.empty(len(starts), dtype=np.uint32)
        missing = np.ones(len(starts), dtype=bool)
        if self.automaton is not None:
            found = np.fromiter(self.automaton.iter(plain.decode("latin-1")), dtype=np.dtype((np.int64, 2)))
            ends = starts + sizes
            at = np.searchsorted(ends, found[:, 0])  # a match ends on the blank behind its word
            crc[at], blank_crc[at], missing[at] = self.crc[found[:, 1]], self.blank_crc[found[:, 1]], False
        rest = np.flatnonzero(missing)
        words = [plain[a : a + n] for a, n in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True)]
        crc[rest] = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
        blank_crc[rest] = np.fromiter((zlib.crc32(b" " + w) for w in words), dtype=np.uint32, count=len(words))
        if words and len(self.words) < self.most_words:
            self.learn(words)
        return starts, sizes, crc, blank_crc


def _blocks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(plain text between blanks, start of each document in it): blocks of whole documents, long ones cut at a blank.

    The first document of a block may go on from the last of the block before; its start is then -1.
    """
    held, starts, size = [b" "], [], 1
    for text in texts:
        plain = text.translate(_PLAIN)
        starts.append(size)
        at = 0
        while len(plain) - at + size > BLOCK:
            cut = plain.find(b" ", at + max(0, BLOCK - size))
            if cut < 0:
                break
            held.append(plain[at:cut] + b" ")
            yield b"".join(held), np.array(starts, dtype=np.int64)
            held, starts, size, at = [b" "], [-1], 1, cut + 1
        held.append(plain[at:] + b" ")
        size += len(plain) - at + 1
    yield b"".join(held), np.array(starts, dtype=np.int64)


def _features(texts: list[bytes], dictionary: Dictionary, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document of each word, its bucket, bucket of the run that it ends or -1) of block after block of ``texts``."""
    last, before = -1, None
    for plain, starts in _blocks(texts):
        goes_on = len(starts) and starts[0] < 0
        at, size, crc, blank_crc = dictionary.scan(plain)
        doc = np.searchsorted(starts, at, side="right") - 1 + (last if goes_on else last + 1)
        last += len(starts) - (1 if goes_on else 0)
        runs = np.full(len(at), -1, dtype=np.int64)
        if len(at) > 1:
            same = np.flatnonzero(doc[1:] == doc[:-1]) + 1
            runs[same] = joined_crc(crc[same - 1], blank_crc[same], size[same] + 1) % np.uint32(buckets)
        if len(at):
            if before is not None and before[0] == doc[0]:
                runs[0] = joined_crc(before[1], blank_crc[:1], size[:1] + 1)[0] % np.uint32(buckets)
            before = (doc[-1], crc[-1:])
        yield doc, (crc % np.uint32(buckets)).astype(np.int64), runs


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most_words: int = DICTIONARY_WORDS) -> DataFrame:
    """(bucket, n) over all features of ``texts`` (text); buckets without a feature have no row. Null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, n = Dictionary(most_words), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, words, runs in _features(batch["text"].cast(pa.binary()).to_pylist(), dictionary, buckets):
                n += np.bincount(words, minlength=buckets) + np.bincount(runs[runs >= 0], minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["bucket", "n"])

    return texts.select(text_of().alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, most_words: int = DICTIONARY_WORDS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket; the driver gets two rows a bucket at most."""
    counts = []
    for table in (documents, target):
        n = np.zeros(buckets, dtype=np.int64)
        for bucket, k in bucket_counts(table, buckets, most_words).collect():
            n[bucket] = k
        counts.append(n)
    s, t = (n.astype(np.float64) for n in counts)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def importance_weights(documents: DataFrame, gains: np.ndarray, most_words: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, order, n_words, n_features, weight) for each row of ``documents``: weight is the floored mean gain of its features.

    Texts without words have weight 0. order tells rows of one doc_id apart by their texts.
    """
    table = documents.sparkSession.sparkContext.broadcast(gains)  # as wide as there are buckets, whatever the corpus

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, gain = Dictionary(most_words), table.value
        for batch in batches:
            rows = len(batch)
            n, features, total = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for doc, words, runs in _features(batch["text"].cast(pa.binary()).to_pylist(), dictionary, len(gain)):
                if len(doc):
                    pair = runs >= 0
                    n += np.bincount(doc, minlength=rows)
                    features += np.bincount(doc, minlength=rows) + np.bincount(doc[pair], minlength=rows)
                    np.add.at(total, doc, gain[words])
                    np.add.at(total, doc[pair], gain[runs[pair]])
            weight = total // np.maximum(features, 1)  # rounds down
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["order"], pa.array(n), pa.array(features), pa.array(weight)], names=["doc_id", "order", "n_words", "n_features", "weight"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("order"), text_of().alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, order long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h from the first 8 hex digits of sha256(seed:doc_id); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with rank 1, 2, 3... in ``order``: ranges of the order are ranked each for itself and moved by the rows before them.

    ``order`` must tell all rows apart that a range should not hold together.
    """
    parts = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = scratch.table(parts, name)
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number for each range
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append((part, total))
        total += sizes.get(part, 0)
    moved = rows.sparkSession.createDataFrame(before, "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(moved), "part").withColumn("rank", (F.col("before") + within).cast("long")).drop("part", "before")


def importance_resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, most_words: int = DICTIONARY_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``documents`` (doc_id, text), drawn toward ``target`` (text).

    score is the weight and a Gumbel number of the doc_id. Of the N rows with ``least_words`` words, floor(percent N / 100) with
    the highest scores are drawn, ties to the smaller doc_id (null last), then by text; rank is 1 for the highest, null for
    rows not drawn. Null texts have no words, weight 0 and are never drawn. Rows that repeat are scored each and draw alike;
    which of them has which rank doesn't matter. Words of any length and very long texts are counted whole, in blocks. An
    empty table gives an empty result, an empty target a T of 0. Other columns are ignored.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    gains = bucket_gains(documents, target, buckets, most_words)
    rows = importance_weights(documents, gains, most_words).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "weights")
    draw = rows.filter(F.col("n_words") >= least_words).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("order"), F.col("row")]
    enough = ranked(rows.filter(F.col("n_words") >= least_words), order, scratch, "ranges")
    enough = enough.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    few = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return enough.unionByName(few).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(documents: DataFrame, target: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """The rows of ``documents`` whose doc_id is drawn, columns unchanged; rows with a null doc_id are never taken."""
    drawn = importance_resample(documents, target, scratch=scratch, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return documents.join(drawn, F.col("doc_id").cast("long") == F.col("_drawn"), "left_semi")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: CRCs of all distinct features byte by byte: each round takes one byte of every feature that has one left.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
b AS (SELECT -row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
w AS (SELECT r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (SELECT r, t FROM d UNION ALL SELECT r, t FROM b)),
f AS (SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
k AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
bits AS (SELECT b::BIGINT AS c, b AS byte, 0 AS k FROM range(256) t(b) UNION ALL
  SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, byte, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT byte, c FROM bits WHERE k = 8),
crc AS (SELECT f, x, 1 AS i, 4294967295::BIGINT AS c FROM k UNION ALL
  SELECT crc.f, crc.x, i + 2, xor(crc.c >> 8, tab.c) FROM crc JOIN tab ON tab.byte = xor(crc.c & 255, ('0x' || substr(x, i, 2))::BIGINT) WHERE i < length(x)),
h AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE i > length(x)),
n AS (SELECT r, bucket, count(*) AS n FROM f JOIN h USING (f) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (r < 0), 0)::DOUBLE AS t FROM n GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s),
m AS (SELECT r, sum(n) AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)) AS weight FROM n JOIN g USING (bucket) GROUP BY r),
o AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(ws) AS words,
  ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h, t FROM d JOIN w USING (r) LEFT JOIN m USING (r)),
p AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM o),
q AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, t) AS k, count(*) FILTER (words >= 20) OVER () AS many FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= 25 * many // 100 THEN k END AS rank FROM q
"""
