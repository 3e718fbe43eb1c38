"""N-gram Jaccard join: candidates share prefix tokens under several global orders, then their sets are compared.

A text's tokens are the 64-bit hashes of its distinct shingles; equal sets are one set. Two sets whose Jaccard similarity
reaches the bound share so many tokens that each of them has one among its first few, whatever order all tokens are put in;
and l of them, if l - 1 places more are looked at. The orders are used one after the other, each on what the last one left:

1. by hash: of the first places each set counts the tokens that another set has among its own. Sets with fewer than l leave;
   these are nearly all that resemble no other.
2. rarest first, ties by hash: of the sets left, a set whose tokens held by no other fill the prefix leaves; of the others the
   prefix gives candidates.
3. by the power of two of a token's frequency, ties by another hash: a candidate must share a token of these prefixes too.

A token that very many sets hold is at the end of a rare-first prefix, but groups of near copies hold hundreds of such tokens
in common. Their pairs are never listed. In each group of sets that share a prefix token all are compared with one of them,
and what is found alike becomes one component; only sets whose component isn't the largest in the group are then compared with
the rest of it. So no link between two components is missed, and links within a component aren't needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._common import Scratch, read, text_of, with_groups
from textloom.llm.components import connected_components
from textloom.llm.rolling import mixed
from textloom.operators.key_filter import KeyFilter

SHINGLE = 5
PERCENT = 80
#: Part of a prefix's length by which the first order looks further.
FURTHER = 0.5

_ODD = np.random.default_rng(20240613).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words of UTF-8 bytes; of fewer words one hash, of none nothing."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white spaces only
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        sums += hashes[k : k + n] * _ODD[k]
    return np.unique(mixed(sums))


def _first_places(n: int, percent: int, further: float) -> tuple[int, int]:
    """(places looked at in the first order, tokens that a partner shares among them at least)."""

    def fewest(m: int) -> int:  # tokens that a set of m shares with any that is similar enough
        return -(-percent * m // 100)

    def shared(m: int) -> int:
        return min(int(further * (m - fewest(m) + 1)) + 1, fewest(m))

    # The smallest partner has ``fewest`` tokens, and looks for the fewest shared ones.
    return n - fewest(n) + shared(n), shared(fewest(n))


def _lists(tokens: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens).view(np.int64) if tokens else np.empty(0, dtype=np.int64)))


def _sets(batches: Iterator[pa.RecordBatch], size: int, percent: int, further: float) -> Iterator[pa.RecordBatch]:
    """Each text's number of tokens, the 128-bit digest of its set, and the tokens at its first places by hash."""
    for batch in batches:
        n, k1, k2, least, places = [], [], [], [], []
        for text in batch["text"].cast(pa.binary()).to_pylist():
            found = shingle_set(text, size)
            digest = xxhash.xxh3_128_intdigest(found.tobytes())
            n.append(len(found))
            k1.append(digest >> 64)
            k2.append(digest & (1 << 64) - 1)
            looked_at, shared = _first_places(len(found), percent, further) if len(found) else (0, 0)
            least.append(shared)
            places.append(found[:looked_at])
        signed = [pa.array(np.array(k, dtype=np.uint64).view(np.int64)) for k in (k1, k2)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["d1"], batch["d2"], pa.array(n, pa.int64()), *signed, pa.array(least, pa.int64()), _lists(places)], names=["doc_id", "d1", "d2", "n", "k1", "k2", "least", "tokens"])


def _tokens(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(text, size) for text in batch["text"].cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["set"], _lists(found)], names=["set", "tokens"])


CELLS = 1 << 14


def _cell(token: Column) -> Column:
    return F.pmod(token, F.lit(CELLS)).cast("int")


def hot_cells(tokens: DataFrame, share: float = 0.001) -> dict[int, int]:
    """Cells of tokens that hold over ``share`` of all rows and twice the mean, with their rows; the driver gets ``CELLS`` numbers."""
    cells = tokens.groupBy(_cell(F.col("token")).alias("cell")).agg(F.count("*").alias("n")).collect()
    whole = sum(r.n for r in cells)
    return {r.cell: r.n for r in cells if r.n > share * whole and r.n > 2 * whole / CELLS}


def _shared(tokens: DataFrame) -> DataFrame:
    """The rows of ``tokens`` (token, set) whose token another set may hold, with c, the number of sets that do.

    Any numbers make an order, as long as a token that one set holds alone comes first. Tokens of hot cells are held by so
    many sets that their rows must not meet in one task: they stay where they are and count as their whole cell. The others
    are counted where they meet, in one shuffle.
    """
    hot = hot_cells(tokens)
    cell = _cell(F.col("token"))
    met = tokens.filter(~cell.isin(*hot)) if hot else tokens
    met = met.repartition("token").groupBy("token", "set").agg(F.count("*").alias("rows")).drop("rows")
    rare = met.withColumn("c", F.count("*").over(Window.partitionBy("token"))).filter("c > 1")
    if not hot:
        return rare
    counts = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
    return rare.unionByName(tokens.filter(cell.isin(*hot)).select("token", "set", F.element_at(counts, cell).cast("long").alias("c")))


def prefix_length(n: Column, percent: int) -> Column:
    """Places of which one must hold a token of any set that is similar enough."""
    return n - F.ceil(n * percent / F.lit(100.0)) + 1


def prefix_sets(documents: DataFrame, scratch: Scratch, size: int = SHINGLE, percent: int = PERCENT, further: float = FURTHER) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): rows (doc_id, n, k1, k2) for each document, and of the sets that two orders leave
    (set, k1, k2, n, u, tokens, second, third).

    tokens are those that another set left has too, rarest first; u is how many it has alone. second and third are the
    prefixes under the second and third order, without the tokens that it has alone.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("d1", F.xxhash64("doc_id", "text")).withColumn("d2", F.xxhash64("text", "doc_id"))
    schema = "doc_id long, d1 long, d2 long, n long, k1 long, k2 long, least long, tokens array<long>"
    wide = scratch.table(docs.mapInArrow(lambda b: _sets(b, size, percent, further), schema), "wide")
    rows = scratch.table(wide.drop("tokens"), "rows")

    # First order: by hash. Copies of a set repeat its rows.
    first = wide.select(F.col("k1").alias("set"), F.explode("tokens").alias("token"))
    counts = _shared(first).groupBy(F.col("set").alias("k1")).agg(F.count_distinct("token").alias("shared"))
    sets = rows.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("least").alias("least"), F.min(F.struct("d1", "d2")).alias("d"))
    one = sets.join(counts, "k1").filter("shared >= least").select("k1", "k2", "n", "d.d1", "d.d2")
    one = scratch.table(one.withColumn("set", F.monotonically_increasing_id()), "sets")
    scratch.drop("wide")

    # Second order: rarest first. One text of each set left; others don't pass the filter and aren't shuffled.
    copies = rows.groupBy("d1", "d2").agg(F.count("*").alias("copies"))
    chosen = scratch.table(one.join(copies, ["d1", "d2"]).select("d1", "d2", "set", "copies"), "chosen")
    only = KeyFilter.build(chosen, ["d1", "d2"])
    texts = docs.select("d1", "d2", "text")
    texts = with_groups(texts if only is None else texts.filter(only.may_hold("d1", "d2")), chosen, ["d1", "d2"], "copies").select("set", "text")
    every = scratch.table(texts.mapInArrow(lambda b: _tokens(b, size), "set long, tokens array<long>"), "every").select("set", F.explode("tokens").alias("token"))
    held = _shared(every).groupBy("set").agg(F.collect_set(F.struct("c", "token")).alias("held"))
    held = held.join(one.select("set", "k1", "k2", "n"), "set").withColumn("u", F.col("n") - F.size("held"))
    places = (prefix_length(F.col("n"), percent) - F.col("u")).cast("int")
    held = held.filter(places > 0)

    def ordered(seed: int, frequency) -> Column:
        return F.array_sort(F.transform("held", lambda h: F.struct(frequency(h["c"]).alias("c"), F.xxhash64(F.lit(seed), h["token"]).alias("h"), h["token"].alias("token"))))

    second, third = ordered(2, lambda c: c), ordered(3, lambda c: F.floor(F.log2(c)))
    tokens = held.select("set", "k1", "k2", "n", "u", places.alias("places"), F.transform(second, lambda x: x["token"]).alias("tokens"), F.slice(F.transform(third, lambda x: x["token"]), F.lit(1), places).alias("third"))
    found = scratch.table(tokens.withColumn("second", F.slice("tokens", F.lit(1), F.col("places"))).drop("places"), "prefixes")
    scratch.drop("every", "chosen", "sets")
    return rows, found


def _pairs(members: DataFrame, name: str, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: sets of different components that share a token of the prefix ``name`` where both could still be similar.

    In each group the sets of its largest component are met by all others, not by each other.
    """
    at = members.select("set", "n", "u", "component", F.posexplode(name).alias("i", "token"))
    groups = at.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"))
    several = scratch.table(groups.filter("low <> high").select("token", "rows"), "several")
    met = scratch.table(with_groups(at, several, ["token"], "rows"), "met")
    parts = met.groupBy("token", "component").agg(F.count("*").alias("k"))
    largest = scratch.table(parts.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.sum("k").alias("rows")), "largest")
    others = with_groups(met, largest, ["token"], "rows").filter("component <> largest").select("token", *(F.col(c).alias(f"o_{c}") for c in ("set", "n", "u", "component", "i")))
    # At the first token that two sets share, all that they can still share is what follows in both.
    reach = F.least(F.col("n") - F.col("u") - F.col("i"), F.col("o_n") - F.col("o_u") - F.col("o_i"))
    enough = (reach * (100 + percent) >= percent * (F.col("n") + F.col("o_n"))) & (F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * percent)
    pairs = met.join(others, "token").filter((F.col("component") != F.col("o_component")) & enough)
    return scratch.table(pairs.select(F.least("set", "o_set").alias("a"), F.greatest("set", "o_set").alias("b")).distinct(), f"pairs_{name}")


def _stars(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): each set and one of its group, of its own length class; the one with the fewest tokens of its own."""
    # A set similar to one of a class is in the class or next to it; what stars miss the pairs find.
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int")
    at = members.select("set", "u", band.alias("band"), F.explode("second").alias("token"))
    centres = at.groupBy("token", "band").agg(F.min(F.struct("u", "set"))["set"].alias("centre"), F.count("*").alias("rows")).filter("rows > 1")
    met = with_groups(at.drop("u"), scratch.table(centres, "centres"), ["token", "band"], "rows").filter("set <> centre")
    return met.select(F.least("set", "centre").alias("a"), F.greatest("set", "centre").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a, b) of sets that share a token under the third order too and whose similarity reaches the bound.

    A set that very many pairs name is copied as often as needed and its pairs are dealt over the copies.
    """
    pairs = scratch.table(pairs, "pairs")
    whole = pairs.count()
    share = max(1000, whole // 1000)
    met = pairs
    for side in ("a", "b"):
        load = pairs.groupBy(side).agg(F.count("*").alias("k")).select(side, F.ceil(F.col("k") / share).cast("int").alias("times"))
        heavy = load.filter("times > 1")  # a thousand at most, numbers only
        copy = F.pmod(F.xxhash64("a", "b"), F.coalesce("times", F.lit(1))).cast("int")
        met = met.join(F.broadcast(heavy), side, "left").withColumn("copy", copy).drop("times")
        copies = sets.select(F.col("set").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "tokens", "third"))).join(load, side)
        met = met.join(copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times"), [side, "copy"]).drop("copy")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    alike = both * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n"))
    return met.filter(F.arrays_overlap("a_third", "b_third") & alike).select(F.col("a").alias("u"), F.col("b").alias("v"))


def jaccard_links(sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """(u, v): links of ``prefix_sets`` that connect exactly what all links between them connect."""
    links = scratch.table(verified(_stars(sets, percent, scratch), sets, scratch, percent), "stars")
    scratch.drop("centres")
    component = connected_components(links, scratch).select(F.col("node").alias("set"), F.col("component").alias("of"))
    members = sets.select("set", "n", "u", "second", "third").join(component, "set", "left")
    members = scratch.table(members.withColumn("component", F.coalesce("of", "set")).drop("of"), "members")
    # Under the second and the third order alike.
    candidates = _pairs(members, "second", percent, scratch).join(_pairs(members, "third", percent, scratch), ["a", "b"], "left_semi")
    return links.unionByName(verified(candidates, sets, scratch, percent))


def jaccard_components(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, further: float = FURTHER, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``documents`` (doc_id, text).

    n_shingles is the number of distinct shingles of ``size`` words; a text with fewer words is one shingle. Rows whose sets
    have a Jaccard similarity of ``percent`` or more are linked; component_id is the smallest doc_id reachable, the row's own
    included. Null texts and texts without words have no shingle and no link. A null doc_id is never the smallest unless its
    component has no other. Rows that repeat each get a row. Texts are taken whole. An empty table gives an empty result;
    other columns are ignored. Shingles are compared by 64 bits of hash, equal sets by 128.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    rows, sets = prefix_sets(documents, scratch, size, percent, further)
    links = scratch.table(jaccard_links(sets, scratch, percent), "links")
    component = scratch.table(connected_components(links, scratch).withColumnRenamed("node", "set"), "component")
    least = scratch.table(rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count("*").alias("copies")), "least")
    named = scratch.table(component.join(sets.select("set", "k1", "k2"), "set").join(least, ["k1", "k2"]).select("k1", "k2", "component", "least"), "named")
    smallest = scratch.table(named.groupBy("component").agg(F.min("least").alias("smallest"), F.count("*").alias("held")), "smallest")
    linked = with_groups(named.drop("least"), smallest, ["component"], "held").select("k1", "k2", "smallest")
    by_set = scratch.table(least.filter("n > 0").join(linked, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("smallest", "least").alias("component_id"), "copies"), "by_set")
    some = with_groups(rows.filter("n > 0"), by_set, ["k1", "k2"], "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


#: All pairs that share a shingle, counted; then everything reachable.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS s FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
c AS (SELECT r, r AS other FROM d UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.other)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN c USING (r) JOIN d o ON o.r = c.other GROUP BY d.r, d.doc_id
"""
