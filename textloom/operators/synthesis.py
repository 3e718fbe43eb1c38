"""Synthetic and augmented rows. Every choice comes from md5(seed:key), so a rerun gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(seed: int, *keys: Column) -> Column:
    """A number below 2**32 for a key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))), 1, 8), 16, 10).cast("long")


#: Characters of no width that an augmented text may get.
ZERO_WIDTH = ("\u200b", "\u200c", "\u200d")


def augment(rows: DataFrame, seed: int = 42) -> DataFrame:
    """``rows`` (id, text, ...) and their changed children, ids linked.

    By two draws a child gets a character of no width at a drawn place, and blanks around its full-width commas, each in
    half of the rows; a row whose text neither changes has no child.
    """
    width, comma = draw(seed, F.lit("width"), F.col("id")), draw(seed, F.lit("comma"), F.col("id"))
    n = F.length("text")
    at = (F.floor(width / 2) % F.greatest(n, F.lit(1))).cast("int")
    mark = F.element_at(F.array(*(F.lit(c) for c in ZERO_WIDTH)), (width % 3 + 1).cast("int"))
    changed = F.when((width % 2 == 0) & (n > 0), F.concat(F.substring("text", F.lit(1), at), mark, F.substring("text", at + 1, n))).otherwise(F.col("text"))
    changed = F.when(comma % 2 == 0, F.replace(changed, F.lit("，"), F.lit(" ， "))).otherwise(changed)
    children = rows.withColumn("_changed", changed).filter("_changed <> text").withColumn("parent_id", F.col("id")).withColumn("id", F.concat("id", F.lit("-aug-1"))).withColumn("is_adversarial", F.lit(True))
    children = children.withColumn("text", F.col("_changed")).drop("_changed")
    return rows.withColumn("parent_id", F.lit(None).cast("string")).withColumn("is_adversarial", F.lit(False)).unionByName(children)


def synthesize(numbers: DataFrame, templates: Sequence[tuple[str, str, str]], seed: int = 42) -> DataFrame:
    """(id, language, label, sender_group, template_group, text): each template (language, label, text with ``{n}``) for each number ``n``."""
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(language).alias("language"), F.lit(label).alias("label"), F.lit(text).alias("text")) for k, (language, label, text) in enumerate(templates)))
    rows = numbers.select("n", F.explode(table).alias("t")).select("n", "t.*")
    filled = F.replace("text", F.lit("{n}"), (draw(seed, F.col("k"), F.col("n")) % 900_000 + 100_000).cast("string"))
    group = F.concat(F.lit("-"), F.col("language"), F.lit("-"))
    return rows.select(
        F.concat_ws("-", "language", F.col("k").cast("string"), F.col("n").cast("string")).alias("id"), "language", "label", F.concat(F.lit("snd"), group, (F.col("n") % 5).cast("string")).alias("sender_group"),
        F.concat(F.lit("tpl"), group, F.col("k").cast("string")).alias("template_group"), filled.alias("text"),
    )
