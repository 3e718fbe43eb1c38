"""Line deduplication with an edit bound of one word, by a deletion-neighbourhood join. DataFrame operations only.

Lines within one word of each other (one word replaced, inserted or left out) share a deletion variant: the line itself
or the line without one of its words. Variants are emitted as hashed keys and joined on equality. Two lines of equal
length must lose the word at the same place, and a line can meet a longer one only where it lost nothing itself; that and
a comparison of the words verifies the edit distance. Of a group that shares a key only the earliest line is compared with
the rest, which is enough to find for each line whether an earlier one is near it, so groups of any size stay linear. Lines
of a group that holds very many stay where they are, and the group's earliest is sent to them.

Variants are emitted only for lines that can have a neighbour: one edit leaves the words of one half of a line as they are,
so a line near another shares the hash of a half's words with it. Hashes of words are combined by exclusive or over running
windows, so a line with n words costs n rows, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._common import SPACES, Scratch, hashed_documents, read, with_groups


def _words(line: Column) -> Column:
    """Words of a line; the regular expression runs only where more than single blanks part them."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(line, F.lit(c))
    return F.split(F.trim(F.when(odd, F.regexp_replace(line, f"{SPACES}+", " ")).otherwise(line)), " ", -1)


def _half_size(n: Column) -> Column:
    """How many words of a half are hashed: the largest of 1, 2, 3, 4, 6, 8, 12 and so on that is half of ``n`` at most."""
    power = F.pow(F.lit(2), F.floor(F.log2(F.greatest(n, F.lit(2)).cast("double") + 0.5)) - 1).cast("int")  # of two, half of n at most
    return F.when((power >= 4) & (power / 2 * 3 <= n / 2), (power / 2 * 3).cast("int")).otherwise(power)


def line_places(documents: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, k1, no, h1, h2, front, back, front2, back2) for each line that isn't blank.

    h1 and h2 hash the words. front and back hash as many words from either end as fit into a half; where a line with a word
    less has smaller halves, front2 and back2 hash those.
    """
    lines = hashed_documents(documents).select("doc_id", "k1", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    words = lines.select("doc_id", "k1", "no", F.explode(F.array(_words(F.col("line")))).alias("words")).filter("words[0] <> '' OR size(words) > 1")
    hashes = words.select("doc_id", "k1", "no", F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("w"))
    n = F.size("w")
    size, less = _half_size(n), _half_size(n - 1)
    enough = n >= least_words
    changes = enough & (size != less)

    def half(k: Column, front: bool) -> Column:
        return F.xxhash64(k, F.lit(front), F.slice("w", F.lit(1) if front else n - k + 1, k))

    return hashes.select(
        "doc_id", "k1", "no", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(2), "w").alias("h2"), F.when(enough, half(size, True)).alias("front"), F.when(enough, half(size, False)).alias("back"),
        F.when(changes, half(less, True)).alias("front2"), F.when(changes, half(less, False)).alias("back2"),
    )


def near_lines(documents: DataFrame, first: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2) of the lines of ``first`` that are near a line with an earlier place."""
    halves = first.select("h1", "h2", F.explode(F.array("front", "back", "front2", "back2")).alias("half")).filter("half IS NOT NULL")
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("n")).filter("low <> high").select("half", "n")
    possible = with_groups(halves, scratch.table(shared, "halves"), ["half"], "n").select("h1", "h2").distinct()
    at = first.select("h1", "h2", "place").join(possible, ["h1", "h2"], "left_semi").groupBy(F.col("place.k1").alias("of_k1"), F.col("place.doc_id").alias("of_doc")).agg(F.collect_list(F.struct("place", "h1", "h2")).alias("at"))
    docs = hashed_documents(documents).select("doc_id", "k1", "text")
    found = docs.join(at, (F.col("k1") == F.col("of_k1")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select(F.explode("at").alias("at"), F.split("text", "\n").alias("lines"))
    found = found.select("at.place", "at.h1", "at.h2", _words(F.get("lines", F.col("at.place.no"))).alias("words"))
    lines = scratch.table(found.withColumn("line", F.monotonically_increasing_id()), "lines")

    word = lines.select("line", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    hashes = [F.xxhash64(F.lit(seed), F.col("word"), at).alias(name) for seed, at, name in ((1, F.col("i"), "a1"), (2, F.col("i"), "a2"), (1, F.col("i") - 1, "b1"), (2, F.col("i") - 1, "b2"))]
    before = Window.partitionBy("line").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("line").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("line")
    none = F.lit(0).cast("long")

    def variant(k: int) -> Column:
        """Words before i at their places, those after it a place earlier."""
        after = F.bit_xor(f"b{k}").over(whole).bitwiseXOR(F.bit_xor(f"b{k}").over(upto))
        return F.coalesce(F.bit_xor(f"a{k}").over(before), none).bitwiseXOR(after)

    variants = word.select("line", "n", "i", *hashes).select("line", (F.col("n") - 1).alias("size"), "i", variant(1).alias("v1"), variant(2).alias("v2"))
    entire = word.select("line", "n", *hashes[:2]).groupBy("line", F.col("n").alias("size")).agg(F.lit(-1).alias("i"), F.expr("bit_xor(a1)").alias("v1"), F.expr("bit_xor(a2)").alias("v2"))
    keyed = scratch.table(variants.unionByName(entire), "variants")
    met = keyed.groupBy("v1", "v2").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.count("*").alias("n")).filter("low <> high").select("v1", "v2", "n")
    together = with_groups(keyed, scratch.table(met, "met"), ["v1", "v2"], "n").join(lines.select("line", "place"), "line").drop("line")
    together = scratch.table(together, "together")
    scratch.drop("variants", "met", "halves")

    # Lines of equal length, without the word at the same place.
    key = ["v1", "v2", "size", "i"]
    replaced = scratch.table(together.filter("i >= 0").groupBy(*key).agg(F.min("place").alias("other"), F.count("*").alias("n")).filter("n > 1"), "replaced")
    links = with_groups(together, replaced, key, "n").filter("other < place").select("place", "other")
    # A line and one with a word more.
    key = ["v1", "v2", "size"]
    met = together.groupBy(*key).agg(F.min(F.when(F.col("i") < 0, F.col("place"))).alias("shorter"), F.min(F.when(F.col("i") >= 0, F.col("place"))).alias("longer"), F.count("*").alias("n")).filter("shorter IS NOT NULL AND longer IS NOT NULL")
    other = F.when(F.col("i") < 0, F.col("longer")).otherwise(F.col("shorter"))
    links = links.union(with_groups(together, scratch.table(met, "lengths"), key, "n").withColumn("other", other).filter("other < place").select("place", "other")).distinct()
    links = scratch.table(links, "links")

    # Verification: the words themselves.
    mine = lines.select("place", "h1", "h2", "words")
    theirs = links.groupBy("other").agg(F.count("*").alias("n")).join(lines.select(F.col("place").alias("other"), F.col("words").alias("others")), "other")
    return with_groups(links, scratch.table(theirs, "theirs"), ["other"], "n").join(mine, "place").filter(within_one_word(F.col("words"), F.col("others"))).select("h1", "h2").distinct()


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by one word replaced, inserted or left out, or not at all."""
    n, m = F.size(a), F.size(b)
    least = F.least(n, m)
    from_front = F.size(F.filter(F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: x == y), lambda same: ~same))
    longer, shorter = F.when(n > m, a).otherwise(b), F.when(n > m, b).otherwise(a)
    apart = F.array_position(F.zip_with(F.slice(longer, 1, least), shorter, lambda x, y: x == y), False).cast("int")
    rest_equal = (apart == 0) | (F.slice(longer, apart + 1, least) == F.slice(shorter, F.greatest(apart, F.lit(1)), least))
    return F.when(n == m, from_front <= 1).otherwise((F.abs(n - m) == 1) & rest_equal)


def line_decisions(documents: DataFrame, least_words: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, k1, no, kind) for each line that isn't blank: ``first``, ``exact`` or ``near``.

    Lines are in the order of doc_id (null first), document and line number. A line is exact if an earlier line has the same
    words, and near if its words are within one word of an earlier line's, be that kept or not. White space between words
    doesn't matter. Lines of fewer than ``least_words`` words are compared exactly only: one word of four is a quarter of a
    line. 2 is the least, since single words would all be near each other.
    """
    if least_words < 2:
        raise ValueError("near lines have two words at least")
    scratch = scratch or Scratch(documents.sparkSession)
    lines = scratch.table(line_places(documents, least_words), "places")
    place = F.struct("doc_id", "k1", "no")
    halves = [F.max(c).alias(c) for c in ("front", "back", "front2", "back2")]
    first = scratch.table(lines.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("n"), *halves), "first")
    near = near_lines(documents, first, scratch).withColumn("near", F.lit(True))
    # Only lines that recur or are near another need to be told of it.
    known = scratch.table(first.select("h1", "h2", "n", F.col("place").alias("earliest")).join(near, ["h1", "h2"], "left").filter("n > 1 OR near"), "known")
    scratch.drop("lines", "together", "replaced", "lengths", "links", "theirs", "first")
    kind = F.when(F.col("near"), "near").when(place > F.col("earliest"), "exact").otherwise("first")
    return with_groups(lines.select("doc_id", "k1", "no", "h1", "h2"), known, ["h1", "h2"], "n", "left").select("doc_id", "k1", "no", kind.alias("kind"))


def dedup_lines(documents: DataFrame, least_words: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, k1, n_lines, n_exact, n_near, dropped) for each document of ``documents`` (doc_id, text).

    dropped lists the numbers, from 0, of the lines that go. Blank lines always stay and aren't counted. Null texts count
    as empty and have no lines. Rows that are equal in doc_id and text are one document; other columns are ignored. An
    empty table gives an empty result. ``least_words`` is that of ``line_decisions``.
    """
    rows = line_decisions(documents, least_words, scratch)
    kinds = rows.groupBy(F.col("doc_id").alias("of_doc"), F.col("k1").alias("of_k1")).agg(
        F.count("*").alias("lines"), F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "near").alias("near"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "first", F.col("no")))).alias("gone"),
    )
    copies = hashed_documents(documents).groupBy("doc_id", "k1").agg(F.count("*").alias("copies"))
    zero = F.lit(0).cast("long")
    # Rows that repeat brought each of their lines as often; they are one document.
    joined = copies.join(kinds, (F.col("k1") == F.col("of_k1")) & F.col("doc_id").eqNullSafe(F.col("of_doc")), "left")
    counts = [F.coalesce((F.col(c) / F.col("copies")).cast("long"), zero).alias(f"n_{c}") for c in ("lines", "exact", "near")]
    return joined.select("doc_id", "k1", *counts, F.coalesce(F.array_distinct("gone"), F.array().cast("array<int>")).alias("dropped"))


def without_repeated_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of each document with the lines that ``dedup_lines`` drops left out."""
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("dropped", i.cast("int")))
    gone = dedup_lines(documents).select(F.col("doc_id").alias("of_doc"), F.col("k1").alias("of_k1"), "dropped")
    docs = hashed_documents(documents).dropDuplicates(["doc_id", "k1"])
    return docs.join(gone, (F.col("k1") == F.col("of_k1")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("doc_id", F.array_join(kept, "\n").alias("text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_exact", "n_near", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


ORACLE_SQL = r"""
WITH t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM t),
l AS (SELECT doc_id, no - 1 AS no, trim(regexp_replace(lines[no], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS no FROM s)),
p AS (SELECT *, row_number() OVER (ORDER BY doc_id, no) AS place FROM l WHERE line <> ''),
f AS (SELECT line, min(place) AS place, string_split(line, ' ') AS words FROM p GROUP BY line),
v AS (SELECT place, len(words) - 1 AS size, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') AS variant
  FROM (SELECT place, words, unnest(range(1, len(words) + 1)) AS i FROM f WHERE len(words) >= 5)),
r AS (SELECT DISTINCT place FROM (SELECT place, min(place) OVER (PARTITION BY variant, i, size) AS other FROM v) WHERE other < place),
u AS (SELECT place, line FROM f WHERE len(words) >= 5),
m AS (SELECT u.place AS shorter, v.place AS longer FROM u JOIN v ON u.line = v.variant),
n AS (SELECT place FROM r UNION SELECT greatest(shorter, longer) FROM m),
k AS (SELECT p.doc_id, p.no, CASE WHEN n.place IS NOT NULL THEN 'near' WHEN p.place > f.place THEN 'exact' ELSE 'first' END AS kind
  FROM p JOIN f USING (line) LEFT JOIN n ON n.place = f.place),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (kind = 'exact') AS n_exact, count(*) FILTER (kind = 'near') AS n_near,
  string_agg(no::VARCHAR, ',' ORDER BY no) FILTER (kind <> 'first') AS dropped FROM k GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(dropped, '') AS dropped FROM t LEFT JOIN c USING (doc_id)
"""
