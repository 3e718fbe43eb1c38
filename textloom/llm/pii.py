"""Personal data: patterns, and terms that give the protected values away. DataFrame operations only.

Base spans are the matches of four patterns. Their values are the protected entities. Information-theoretic sanitisation then
asks how much a term tells about an entity: the pointwise mutual information of the two over the corpus, as a share of the
entity's own information content. A share of one means that the term occurs only with the entity. Terms above a threshold
are generalised in the documents that hold the entity, and removed above a second one.

A term stands with an entity if the two are in the same or in neighbouring passages of ``PASSAGE`` characters. So a document
gives pairs in proportion to its length, however many entities it lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm._common import Scratch, hashed_documents, read, with_groups

#: Leftmost matches of the stated patterns. Where a match can't start within a run that failed as a whole, a look-behind skips
#: the run (\G lets a match follow the one before); possessive repeats replace greedy ones that could not give back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
LETTERS = r"[\p{L}\p{N}]+"
PASSAGE = 1_000


def placed(docs: DataFrame, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(k1, k2, i, found, start, end, *carry) for each match of ``pattern`` in ``text``; code points, end exclusive.

    Matches and the gaps between them alternate, so a running sum of their lengths gives the places.
    """
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    some = docs.filter(F.col("text").rlike(pattern)).select("k1", "k2", *carry, found.alias("all"), F.transform(F.split("text", pattern, -1), F.length).alias("gaps"))
    rows = some.select("k1", "k2", *carry, F.posexplode(F.transform("all", lambda m, i: F.struct(m.alias("found"), F.get("gaps", i).alias("gap")))).alias("i", "m"))
    rows = rows.select("k1", "k2", *carry, "i", "m.found", (F.col("m.gap") + F.length("m.found")).alias("step")).dropDuplicates(["k1", "k2", "i"])
    upto = Window.partitionBy("k1", "k2").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum("step").over(upto)).select("k1", "k2", *carry, "i", "found", (F.col("end") - F.length("found")).alias("start"), "end")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when((F.length(digits) - i) % 2 == 1, d * 2).otherwise(d)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), F.lit(4)).cast("int") <= 255))
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, end, entity) of each base span; entity hashes the kind and the value without its separators."""
    out = None
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = placed(docs, pattern).filter(valid(kind, F.col("found")))
        value = F.lower("found") if kind in ("email", "ip") else F.regexp_replace("found", "[^0-9]", "")
        spans = spans.select("k1", "k2", F.lit(number).alias("kind"), "start", "end", F.xxhash64(F.lit(kind), value).alias("entity"))
        out = spans if out is None else out.unionByName(spans)
    return out


def _terms(text: Column, least_letters: int) -> Column:
    """Hashes of the distinct lower-cased words of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least_letters)
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def clear_words(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(k1, k2, start, end, term) of each word of ``docs`` that no base span of its document overlaps; term hashes the word.

    Words and spans meet by passage, so a document with many of both stays linear. A word's passage is that of its first
    character; a longer word than a passage, which could reach over spans far off, meets all spans of its document.
    """
    words = placed(docs, LETTERS).select("k1", "k2", "start", "end", F.xxhash64(F.lower("found")).alias("term"), F.floor(F.col("start") / PASSAGE).alias("passage"))
    over = F.sequence(F.floor(F.col("start") / PASSAGE) - 1, F.floor((F.col("end") - 1) / PASSAGE))
    spans = base.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("start").alias("from"), F.col("end").alias("upto"), F.explode(over).alias("at"))
    overlap = (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")) & (F.col("from") < F.col("end")) & (F.col("upto") > F.col("start"))
    short, long = words.filter(f"end - start <= {PASSAGE}"), words.filter(f"end - start > {PASSAGE}")
    clear = short.join(spans, overlap & (F.col("passage") == F.col("at")), "left_anti")
    return clear.unionByName(long.join(spans, overlap, "left_anti"))


def disclosing_terms(docs: DataFrame, base: DataFrame, scratch: Scratch, least_letters: int, support: int, generalise: float) -> DataFrame:
    """(k1, k2, start, end, share): words to treat in each document, by the most that they disclose of an entity in it.

    share = pmi(entity; term) / information(entity) = log(n * both / (entity * term)) / log(n / entity), counting
    documents; both counts those where the two stand within neighbouring passages. An entity and a pair must occur in
    ``support`` different texts at least, so that the copies of one text are no evidence. Equal rows count as often as
    they come, in every count.
    """
    held = scratch.table(base.select("k1", "k2", "entity", F.floor(F.col("start") / PASSAGE).alias("at")).distinct(), "held")
    times = docs.groupBy("k1", "k2").agg(F.count("*").alias("times"), F.first(F.xxhash64("text")).alias("same"))
    # Entities that recur; then only their documents are read for co-occurring terms.
    texts = scratch.table(times.join(held.select("k1", "k2").distinct(), ["k1", "k2"]), "texts")
    by_text = held.select("k1", "k2", "entity").distinct().join(texts, ["k1", "k2"])
    known = by_text.groupBy("entity").agg(F.count("*").alias("n"), F.sum("times").alias("n_entity"), F.min("same").alias("low"), F.max("same").alias("high")).filter("low <> high AND n_entity >= %d" % support)
    # Every place of an entity counts when rows of one key are told apart; a document has one row for each passage.
    places = held.groupBy("entity").agg(F.count("*").alias("places"))
    known = scratch.table(known.join(places, "entity").select("entity", "n_entity", "places"), "known")
    recurring = scratch.table(with_groups(held, known, ["entity"], "places"), "recurring")
    words = scratch.table(clear_words(docs.join(recurring.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi"), base).filter(f"end - start >= {least_letters}"), "words")
    near = recurring.select("k1", "k2", "entity", "n_entity", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("passage")).distinct()
    terms = words.select("k1", "k2", "term", F.floor(F.col("start") / PASSAGE).alias("passage")).distinct()
    pairs = terms.join(near, ["k1", "k2", "passage"]).select("k1", "k2", "entity", "n_entity", "term").distinct()
    pairs = scratch.table(pairs.join(texts, ["k1", "k2"]), "pairs")
    by_text = pairs.groupBy("entity", "n_entity", "term", "same").agg(F.sum("times").alias("both"), F.count("*").alias("rows"))
    both = by_text.groupBy("entity", "n_entity", "term").agg(F.sum("both").alias("both"), F.count("*").alias("texts"), F.sum("rows").alias("rows"))
    both = scratch.table(both.filter(F.col("both") >= support).filter(F.col("texts") >= support).drop("texts"), "both")
    # Document frequency of every term over the whole corpus: partial counts leave a row for each term and task.
    counts = docs.select(F.explode(_terms(F.col("text"), least_letters)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    met = both.groupBy("term").agg(F.count("*").alias("entities"))
    counts = scratch.table(counts.join(met, "term"), "counts")
    n = docs.agg(F.count("*").alias("n"))
    shares = with_groups(both, counts, ["term"], "entities").crossJoin(F.broadcast(n)).withColumn("share", F.log(F.col("n") * F.col("both") / (F.col("n_entity") * F.col("n_term"))) / F.log(F.col("n") / F.col("n_entity")))
    risky = scratch.table(shares.filter((F.col("n_entity") < F.col("n")) & (F.col("share") >= generalise)).select("entity", "term", "share", "rows"), "risky")
    found = with_groups(pairs.select("k1", "k2", "entity", "term"), risky, ["entity", "term"], "rows").groupBy("k1", "k2", "term").agg(F.max("share").alias("share"))
    return words.join(found, ["k1", "k2", "term"]).select("k1", "k2", "start", "end", "share")


def find_personal_data(documents: DataFrame, least_letters: int = 1, support: int = 3, generalise: float = 0.8, remove: float = 0.95, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, k1, k2, spans) for each document of ``documents`` (doc_id, text); spans: array of (kind, start, end, action).

    kind numbers ``KINDS``; spans are in the order of kind and start, in code points, ends exclusive. Base spans have action
    ``replace``; terms have ``generalise`` or ``remove``, and never overlap a base span. Base spans of different kinds may
    overlap. Terms are words of letters and digits; shorter ones than ``least_letters`` are not counted. Null texts count as
    empty. Rows equal in doc_id and text are one document; as co-occurrences they count as often as they come. An empty
    table gives an empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    docs = hashed_documents(documents)
    base = scratch.table(base_spans(docs), "base")
    terms = disclosing_terms(docs, base, scratch, least_letters, support, generalise)
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    terms = terms.select("k1", "k2", F.struct(F.lit(4).alias("kind"), "start", "end", action.alias("action")).alias("span"))
    based = base.select("k1", "k2", F.struct("kind", "start", "end", F.lit("replace").alias("action")).alias("span"))
    every = based.unionByName(terms).groupBy("k1", "k2").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    return docs.select("doc_id", "k1", "k2").distinct().join(every, ["k1", "k2"], "left")


def sanitised(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, text): each document with base spans and generalised terms replaced by ``[KIND]`` and other terms removed.

    Where base spans overlap, the one that starts first is replaced and what the others add to it goes. Nulls, repeated rows
    and empty tables are as in ``find_personal_data``.
    """
    found = find_personal_data(documents, **options).withColumn("spans", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["action"].alias("action")))))
    joined = hashed_documents(documents).dropDuplicates(["k1", "k2"]).join(found.drop("doc_id"), ["k1", "k2"])
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring("text", (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when((s["action"] == "remove") | (s["start"] < acc["at"]), "").otherwise(F.get(names, s["kind"]))
        return F.struct(F.concat(acc["out"], before, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,kind:int,action:string>>"))
    return joined.select("doc_id", F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text")))).alias("text"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    spans = F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint,action:string>>"))
    found = found.withColumn("spans", spans).withColumn("base", F.filter("spans", lambda s: s["kind"] < 4))
    names = F.array(*(F.lit(k) for k in KINDS))

    def said(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
