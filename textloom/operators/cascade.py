"""Ordered rules in which the first match decides, as one CASE expression."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether a text contains one of ``words``: one alternation of quoted words, compiled once a task."""
    return text.rlike("|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words))


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of ``words`` a text contains."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def cascade(cases: Sequence[tuple[Column, str, str]], default: tuple[str, str]) -> Column:
    """struct(label, reason) of the first case that holds."""
    out = None
    for when, label, reason in cases:
        value = F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))
        out = F.when(when, value) if out is None else out.when(when, value)
    last = F.struct(F.lit(default[0]).alias("label"), F.lit(default[1]).alias("reason"))
    return last if out is None else out.otherwise(last)


def change(cases: Sequence[tuple[Column, str, str]], current: Column) -> Column:
    """struct(label, reason) of the first case that holds, the label null and the reason empty where it is the ``current`` one.

    A case without a label decides that nothing changes. Each condition stands once, so that plans stay small.
    """
    none = F.struct(F.lit(None).cast("string").alias("label"), F.lit("").alias("reason"))
    out = None
    for when, label, reason in cases:
        value = F.when(current == label, none).otherwise(F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))) if label else none
        out = F.when(when, value) if out is None else out.when(when, value)
    return none if out is None else out.otherwise(none)


def changed_rows(rows: DataFrame, decided: Column, *keep: Column | str) -> DataFrame:
    """(*keep, label, reason) of the rows that ``decided``, a struct of ``change``, gives a label.

    The struct passes a generator, so the plan holds its conditions once and no filter takes them apart.
    """
    return rows.select(*keep, F.inline_outer(F.array(decided))).filter("label IS NOT NULL")
