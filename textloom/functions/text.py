"""Column functions over message texts. All but NFKC and the totals of n-grams run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that look alike and what they stand for.
CONFUSABLE_FROM, CONFUSABLE_TO = "аеорсхАЕОРСХ", "aeopcxAEOPCX"
CONFUSABLE_WORDS = {"薇信": "微信", "v信": "微信"}
ZERO_WIDTH = "[​‌‍﻿⁠᠎]"
MAX_LENGTH = 4096
INPUT_BYTES, HEAD_BYTES, TAIL_BYTES = 512, 384, 128


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function; Arrow batches, ASCII passes through."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def map_confusables(text: Column) -> Column:
    """Words first, longest first, then single characters."""
    for word in sorted(CONFUSABLE_WORDS, key=len, reverse=True):
        text = F.replace(text, F.lit(word), F.lit(CONFUSABLE_WORDS[word]))
    return F.translate(text, CONFUSABLE_FROM, CONFUSABLE_TO)


def normalize_text(text: Column, confusables: bool = False, compatibility: bool = True, most: int | None = MAX_LENGTH) -> Column:
    """Null as empty, NFKC, no zero-width characters, one blank between words, at most ``most`` code points.

    ``confusables`` is on when messages are classified and off when they are deduplicated. Messages are cut at 4096 code
    points; ``most=None`` takes texts whole, which long documents need. Only texts beyond ASCII go to Python for NFKC.
    """
    text = F.coalesce(text, F.lit(""))
    if compatibility:
        text = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    text = F.regexp_replace(text, ZERO_WIDTH, "")
    if confusables:
        text = map_confusables(text)
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return text if most is None else F.substring(text, 1, most)


def encode_bytes(text: Column) -> Column:
    """512 ids: UTF-8 bytes plus one, padded with 0; of a longer text the first 384 and the last 128 bytes."""
    raw = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    size = F.length(raw) / 2
    raw = F.when(size > INPUT_BYTES, F.concat(F.substring(raw, 1, 2 * HEAD_BYTES), F.right(raw, F.lit(2 * TAIL_BYTES)))).otherwise(raw)
    ids = F.transform(F.regexp_extract_all(raw, F.lit("(..)")), lambda p: F.conv(p, 16, 10).cast("int") + 1)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), INPUT_BYTES)), 1, INPUT_BYTES)  # what pads needs no conversion


def byte_ngrams(text: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Hex of each window of ``sizes`` bytes, repeats included; the shorter windows first.

    An expression that looks ahead by a window and goes on by a byte finds all windows in one pass over the text.
    """
    raw = F.lower(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    return F.concat(*(F.regexp_extract_all(raw, F.lit(f"(?=(.{{{2 * k}}})).."), 1) for k in sizes))


def ngram_rows(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(*keep, gram): a row for each window of 2 and 3 bytes, the same as ``byte_ngrams`` gives, all in generated code.

    Positions are exploded first and cut out then, so no array of strings is built for a text.
    """
    raw = F.lower(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))).alias("_raw")
    at = rows.select(*keep, raw).filter(F.length("_raw") >= 4).select(*keep, "_raw", F.explode(F.sequence(F.lit(1), F.length("_raw") - 3, F.lit(2))).alias("_at"))
    three = F.when(F.col("_at") + 5 <= F.length("_raw"), F.substring("_raw", F.col("_at"), F.lit(6)))
    return at.select(*keep, F.explode(F.array(F.substring("_raw", F.col("_at"), F.lit(4)), three)).alias("gram")).filter("gram IS NOT NULL")


#: Codes of windows of two bytes are below this, those of three bytes from here on.
TWO = 1 << 16
#: Bytes of text whose windows are held at once.
AT_ONCE = 1 << 20


def gram_code(gram: str) -> int:
    """The code of a window of 2 or 3 bytes, given in hex."""
    return int(gram, 16) + (TWO if len(gram) == 6 else 0)


def window_codes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, rows, row, code) for some texts at a time: the code of each window of 2 and 3 bytes, with the text's place after ``first``."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    held, first = whole.buffers()[2] if len(whole) else None, 0
    data = np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)
    while first < len(whole):
        last = max(first + 1, int(np.searchsorted(at, at[first] + AT_ONCE, "right")) - 1)
        row, raw = np.repeat(np.arange(last - first), np.diff(at[first : last + 1])), data[at[first] : at[last]].astype(np.int32)
        two = raw[:-1] << 8 | raw[1:]
        three = (two[:-1] << 8 | raw[2:]) + TWO
        in_two, in_three = row[:-1] == row[1:], row[:-2] == row[2:]
        yield first, last - first, np.concatenate([row[:-1][in_two], row[:-2][in_three]]), np.concatenate([two[in_two], three[in_three]])
        first = last


def ngram_totals(rows: DataFrame, text: str, parts: bool = False) -> DataFrame:
    """(gram, n): how often each window of 2 and 3 bytes is in all texts, added up for some texts at a time before any row is made of it.

    With ``parts`` the sums of some texts stay as they are, rows that add up.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, codes in window_codes(batch[0]):
                code, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    totals = rows.select(text).mapInArrow(counted, "code int, n long")
    if not parts:
        totals = totals.groupBy("code").agg(F.sum("n").alias("n"))
    size = F.when(F.col("code") < TWO, 4).otherwise(6)
    gram = F.lower(F.lpad(F.hex(F.when(F.col("code") < TWO, F.col("code")).otherwise(F.col("code") - TWO)), size, F.lit("0")))
    return totals.select(gram.alias("gram"), "n")


def ngram_counts(rows: DataFrame, text: str, key: str, vocabulary: DataFrame, at_once: int = 25_000) -> DataFrame:
    """(key, gram, n): how often each n-gram of ``vocabulary`` (gram; a bounded number of rows) is in the texts of a key.

    Texts are dealt by their key, ``at_once`` to a task, before they are cut up, so n-grams are counted where they arise:
    none is shuffled, and a task's counts take the same room however many texts there are.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // at_once))
    grams = ngram_rows(rows.select(key, text).repartition(n, key), F.col(text), key)
    return grams.join(F.broadcast(vocabulary.select("gram")), "gram").groupBy(key, "gram").agg(F.count("*").alias("n"))


def _group(key: Column) -> Column:
    return F.left(F.sha1(key.cast("binary")), F.lit(12))


def template_group(text: Column, style: str, id_column: Column | None = None) -> Column:
    """Twelve hex digits that messages of one template share.

    Styles: ``words`` first ten words, digits and letters a-z only; ``compact`` 40 characters without blanks; ``links`` 160
    characters, links and numbers masked; ``zeros`` digits as 0, an empty text by its id.
    """
    if style == "words":
        key = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\d+", "#"), "[^a-z#]+", " ")
        return _group(F.array_join(F.slice(F.split(F.trim(key), " "), 1, 10), " "))
    if style == "compact":
        return _group(F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)\d+", "#"), r"(?U)\s+", ""), 1, 40))
    if style == "links":
        key = F.regexp_replace(F.lower(text), r"https?://\S+|www\.\S+", "<url>")
        return _group(F.substring(F.trim(F.regexp_replace(F.regexp_replace(key, r"\b\d+\b", "#"), r"(?U)\s+", " ")), 1, 160))
    if style == "zeros":
        key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\d", "0"), r"(?U)\s+", " "))
        return F.when(key == "", F.concat(F.lit("tpl-"), id_column)).otherwise(_group(key))
    raise ValueError(style)


def keyword_fingerprint(text: Column) -> Column:
    """Full-width digits as ASCII, without blanks and slashes: the form in which keywords are looked up."""
    return F.regexp_replace(F.translate(text, "０１２３４５６７８９", "0123456789"), r"(?U)[\s/]+", "")


def script_profile(text: Column) -> Column:
    """Whether a text has CJK and Devanagari letters, and how many of each."""
    cjk, devanagari = r"[\x{4e00}-\x{9fff}]", r"[\x{0900}-\x{097f}]"
    return F.struct(text.rlike(cjk).alias("has_cjk"), text.rlike(devanagari).alias("has_devanagari"), F.regexp_count(text, F.lit(cjk)).alias("n_cjk"), F.regexp_count(text, F.lit(devanagari)).alias("n_devanagari"))


def deliver_key(address: Column, millis: Column, body: Column, subscription: Column) -> Column:
    """SHA-256 that identifies one delivery; a missing part counts as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (address, millis, body, subscription)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def redact_sender(sender: Column) -> Column:
    """Four stars and the last four characters; a short sender is all stars."""
    s = F.trim(F.coalesce(sender, F.lit("")))
    return F.when(F.length(s) <= 4, "****").otherwise(F.concat(F.lit("****"), F.right(s, F.lit(4))))


def quality_score(text: Column, lexicon: tuple[str, ...]) -> Column:
    """How much a text looks like a message: short, a long number, a known word (twice), links or brackets."""
    from textloom.operators.cascade import any_of

    def one(hit: Column, worth: int = 1) -> Column:
        return F.when(hit, worth).otherwise(0)

    return one(F.length(text) <= 200) + one(text.rlike(r"(?U)\d{5,}")) + one(any_of(text, lexicon), 2) + one(text.rlike(r"(?iu)(http|www\.|t\.cn|【|】|退订|回复)"))


def looks_like_message(text: Column, lexicon: tuple[str, ...]) -> Column:
    """4 to 500 characters, not an essay, and a quality score of 2 or more."""
    essay = (F.length(text) > 180) & (F.contains(text, F.lit("。。")) | (F.length(text) - F.length(F.replace(text, F.lit("，"), F.lit(""))) > 8))
    return F.length(text).between(4, 500) & ~essay & (quality_score(text, lexicon) >= 2)
