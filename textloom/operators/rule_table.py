"""Rule tables of any length in one pass over a text: an automaton over literals says which expressions are worth a try.

Whatever an expression matches holds one of a few literals, read off its syntax tree. The literals of all rules are one
automaton; it goes to the executors once, as a broadcast, and finds all of them in a text in one pass. An expression runs
only on texts that hold its literal, so the cost of a text grows with what it holds and not with the number of rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from re import _constants, _parser

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from textloom.operators.classify import Rule, rules_by_priority
from textloom.places import shared_folder

#: So many rules share an automaton; a longer table has several.
RULES_AT_ONCE = 50_000


@lru_cache(maxsize=1 << 16)
def _folded(c: str) -> str:
    upper = c.upper()
    return (upper if len(upper) == 1 else c).lower()[0]


def fold(text: str) -> str:
    """Letters as expressions without regard to case compare them: upper case, then lower, each by itself."""
    return text.lower() if text.isascii() else "".join(map(_folded, text))


def _choices(tree) -> list[frozenset[str]]:
    """Sets of literals, of each of which any match holds one."""
    found, run = [], ""
    for op, value in [*tree, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([fold(run)]))
            run = ""
        if op is _constants.SUBPATTERN:
            found += _choices(value[3])
        elif op is _constants.ATOMIC_GROUP:
            found += _choices(value)
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and value[0] > 0:
            found += _choices(value[2])
        elif op is _constants.BRANCH:
            branches = [_choices(branch) for branch in value[1]]
            if all(branches):
                found.append(frozenset().union(*(max(b, key=lambda s: (min(map(len, s)), -len(s))) for b in branches)))
    return found


def literal_choices(pattern: str) -> list[frozenset[str]]:
    """As ``_choices`` of an expression; none if it can't be read or needs no literal."""
    try:
        return _choices(_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return []


def needed_literals(patterns: Sequence[str]) -> list[frozenset[str]]:
    """For each expression the literals to look for, empty if it must always run: those that the fewest expressions have, then the longest."""
    choices = [literal_choices(p) for p in patterns]
    shared = Counter(literal for sets in choices for literal in frozenset().union(*sets))
    return [min(sets, key=lambda s: (max(shared[x] for x in s), -min(map(len, s)), len(s))) if sets else frozenset() for sets in choices]


class RuleTable:
    """Rules in the order of their priority, ties in the order given, ready to be matched."""

    def __init__(self, spark: SparkSession, rules: Sequence[Rule], at_once: int = RULES_AT_ONCE):
        self.rules, self.parts = rules_by_priority(tuple(rules)), []
        for first in range(0, len(self.rules), at_once):
            part = self.rules[first : first + at_once]
            automaton, holders, always = ahocorasick.Automaton(), {}, []
            for k, literals in enumerate(needed_literals([r.pattern for r in part])):
                if not literals:
                    always.append(k)
                for literal in literals:
                    holders.setdefault(literal, []).append(k)
            for literal, of in holders.items():
                automaton.add_word(literal, tuple(of))
            automaton.make_automaton()
            self.parts.append((part, spark.sparkContext.broadcast((automaton if holders else None, always))))

    def _tried(self, text: Column, table) -> Column:
        @pandas_udf("array<int>")
        def tried(texts: pd.Series) -> pd.Series:
            automaton, always = table.value

            def of(text: str | None) -> list[int] | None:
                if text is None:
                    return None
                found = set(always)
                if automaton is not None:
                    for _, rules in automaton.iter(fold(text)):
                        found.update(rules)
                return sorted(found)

            return texts.map(of)

        return tried(text)

    def tried(self, text: Column) -> Column:
        """How many expressions run on a text."""
        return sum((F.size(self._tried(text, table)) for _, table in self.parts), F.lit(0))

    def match(self, text: Column) -> Column:
        """Ids of all rules found in a text, highest priority first; null text has null."""
        out = []
        for part, table in self.parts:
            patterns, ids = F.array(*(F.lit(f"(?iu){r.pattern}") for r in part)), F.array(*(F.lit(r.id) for r in part))
            found = F.filter(self._tried(text, table), lambda k: F.rlike(text, F.get(patterns, k)))
            out.append(F.transform(found, lambda k: F.get(ids, k)))
        return F.concat(*out) if out else F.when(text.isNotNull(), F.array().cast("array<string>"))


def _literals(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(literal, rule) for each literal that decides about a rule, and the rules that must always run; rules have ``_rule``."""

    def choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[sorted(s) for s in dict.fromkeys(literal_choices(p))] for p in batch["pattern"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["_rule"], pa.array(found, pa.list_(pa.list_(pa.string())))], names=["_rule", "sets"])

    sets = rules.select("_rule", "pattern").mapInArrow(choices, "_rule long, sets array<array<string>>")
    each = sets.select("_rule", F.posexplode("sets").alias("k", "set")).select("_rule", "k", F.explode("set").alias("literal"))
    shared = each.groupBy("literal").agg(F.countDistinct("_rule").alias("n"))
    size = F.length("literal")
    rank = F.struct(F.max("n").alias("n"), (-F.min(size)).alias("least"), F.count("*").alias("words"), F.col("k"))
    best = each.join(shared, "literal").groupBy("_rule", "k").agg(rank.alias("rank"), F.collect_list("literal").alias("set"))
    best = best.groupBy("_rule").agg(F.min_by("set", "rank").alias("set"))
    return best.select("_rule", F.explode("set").alias("literal")), sets.filter(F.size("sets") == 0).select("_rule")


def _held(literals: DataFrame, text: str, key: str, rows: DataFrame) -> DataFrame:
    """(key, literal): every place of a text from which a literal could run, by its first two letters and its length; each once."""
    heads: dict[str, list[int]] = {}
    for r in literals.select(F.left("literal", F.lit(2)).alias("head"), F.length("literal").alias("size")).distinct().toLocalIterator():
        heads.setdefault(r["head"], []).append(r["size"])  # pairs of letters with lengths, whatever the number of rules
    shared = rows.sparkSession.sparkContext.broadcast(heads)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shared.value
        for batch in batches:
            keys, out = [], []
            for k, t in zip(batch[key].to_pylist(), batch[text].to_pylist(), strict=True):
                folded = fold(t or "")
                found = {folded[i : i + n] for i in range(len(folded)) for head in (folded[i], folded[i : i + 2]) for n in heads.get(head, ()) if i + n <= len(folded)}
                keys += [k] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=["_row", "literal"])

    return rows.select(key, text).mapInArrow(held, "_row long, literal string")


def join_rule_table(rows: DataFrame, rules: DataFrame, text: str, key: str, name: str = "rule_ids") -> DataFrame:
    """As ``match_rule_table`` for a table of rules (id, pattern, priority, seq) of any length, none of which passes the driver.

    ``key`` is a long that no two rows share; ``seq`` says which of two rules of one priority comes first. Strings of a text
    that may be literals meet the literals in a join, so the work grows with texts and rules and not with their product.
    Expressions without a literal run on every text.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "rule-table")
    columns = ["id", "pattern", "priority", "seq"]
    rules.select(*columns, F.monotonically_increasing_id().alias("_rule")).write.parquet(f"{folder}/rules")
    rules = spark.read.parquet(f"{folder}/rules")
    for part, of in zip(("literals", "always"), _literals(rules), strict=True):
        of.join(rules, "_rule").write.parquet(f"{folder}/{part}")
    literals, always = spark.read.parquet(f"{folder}/literals"), spark.read.parquet(f"{folder}/always")
    rule = F.struct((-F.col("priority")).alias("order"), "seq", "id", "pattern").alias("rule")
    met = _held(literals, text, key, rows).join(literals, "literal").select(F.col("_row").alias(key), rule)
    tried = met.groupBy(key).agg(F.collect_set("rule").alias("_tried"))
    every = always.agg(F.collect_list(rule).alias("_every"))
    none = F.array().cast(tried.schema["_tried"].dataType)
    joined = rows.join(tried, key, "left").crossJoin(F.broadcast(every)).withColumn("_all", F.array_sort(F.concat(F.coalesce("_tried", none), "_every")))
    found = F.transform(F.filter("_all", lambda r: F.rlike(F.col(text), F.concat(F.lit("(?iu)"), r["pattern"]))), lambda r: r["id"])
    return joined.select(*rows.columns, F.when(F.col(text).isNotNull(), found).alias(name))


def match_rule_table(rows: DataFrame, rules: Sequence[Rule], text: str, name: str = "rule_ids") -> DataFrame:
    """``rows`` with the ids of all ``rules`` found in ``text``; no shuffle."""
    return rows.withColumn(name, RuleTable(rows.sparkSession, rules).match(F.col(text)))
