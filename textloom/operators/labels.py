"""Labels: corrections, joins by id, validation and conversion of annotation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.cascade import any_of
from textloom.schema import LABELS, LANGUAGES, NEEDS_REVIEW, SPLITS


def trainable(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.filter(F.col(label).isin(*LABELS))


def merge_corrections(changes: DataFrame) -> DataFrame:
    """One correction for each id: the highest priority, of equal ones the later; labels that don't exist are ignored."""
    known = changes.filter(F.col("new").isin(*LABELS, NEEDS_REVIEW))
    return known.groupBy("id").agg(F.max_by(F.struct("old", "new", "reason", "source", "priority", "seq"), F.struct("priority", "seq")).alias("c")).select("id", "c.*")


def blocked_transitions(changes: DataFrame, texts: DataFrame, markers: Sequence[str], old: str = "FRAUD", new: str = "AD") -> DataFrame:
    """``changes`` with ``blocked``: a change from ``old`` to ``new`` of a text with a marker is vetoed."""
    joined = changes.join(texts.select("id", F.col("text").alias("_text")), "id", "left")
    veto = (F.col("old") == old) & (F.col("new") == new) & any_of(F.coalesce("_text", F.lit("")), markers)
    return joined.withColumn("blocked", veto).drop("_text")


def apply_corrections(rows: DataFrame, merged: DataFrame, annotator: str = "fix") -> DataFrame:
    """``rows`` with labels set, a note ``[fix:old->new] reason`` added and an empty annotator filled; ``changed`` says where."""
    fix = merged.select("id", F.col("new").alias("_new"), F.col("reason").alias("_reason"))
    joined = rows.join(fix, "id", "left")
    changed = F.col("_new").isNotNull() & (F.col("_new") != F.coalesce("label", F.lit("")))
    note = F.concat(F.lit("[fix:"), F.coalesce("label", F.lit("")), F.lit("->"), F.col("_new"), F.lit("] "), F.coalesce("_reason", F.lit("")))
    notes = F.when(changed, F.concat_ws(" | ", F.nullif("notes", F.lit("")), note)).otherwise(F.col("notes"))
    by = F.when(changed & (F.coalesce("annotator", F.lit("")) == ""), annotator).otherwise(F.col("annotator"))
    out = joined.withColumn("notes", notes).withColumn("annotator", by).withColumn("changed", changed).withColumn("label", F.when(changed, F.col("_new")).otherwise(F.col("label")))
    return out.select(*rows.columns, "changed")


def apply_repairs(rows: DataFrame, decided: DataFrame, tag: str = "fix", annotator: str = "qa_fix_v1", overwrite: bool = False) -> DataFrame:
    """``rows`` with the labels of ``decided`` (id, label, reason) set, as a pass over a whole pack leaves its traces.

    The note ``[tag:reason old->new]`` stands in front of an older one; the annotator is filled if empty, or set by ``overwrite``.
    Old labels count in upper case without blanks; a decision without a label or for the same one changes nothing.
    """
    fix = decided.filter("label IS NOT NULL AND label <> ''").groupBy("id").agg(F.min(F.struct("label", "reason")).alias("_fix"))
    old = F.upper(F.trim(F.coalesce("label", F.lit(""))))
    changed = F.col("_fix").isNotNull() & (F.col("_fix.label") != old)
    note = F.concat(F.lit(f"[{tag}:"), F.coalesce("_fix.reason", F.lit("")), F.lit(" "), old, F.lit("->"), F.col("_fix.label"), F.lit("]"))
    notes = F.concat_ws(" ", note, F.nullif(F.trim(F.coalesce("notes", F.lit(""))), F.lit("")))
    by = F.lit(True) if overwrite else F.trim(F.coalesce("annotator", F.lit(""))) == ""
    joined = rows.join(fix, "id", "left").withColumn("changed", changed)
    out = joined.withColumn("notes", F.when(changed, notes).otherwise(F.col("notes"))).withColumn("annotator", F.when(changed & by, annotator).otherwise(F.col("annotator")))
    return out.withColumn("label", F.when(changed, F.col("_fix.label")).otherwise(F.col("label"))).select(*rows.columns, "changed")


def apply_hand_labels(rows: DataFrame, hand: DataFrame, auto: str | None = None, default: str = NEEDS_REVIEW) -> DataFrame:
    """``rows`` with label and note by id: hand label, else the automatic one, else ``default``."""
    given = hand.groupBy("id").agg(F.max(F.struct("label", "note")).alias("_hand"))
    choice = [F.col("_hand.label")] + ([F.col(auto)] if auto else []) + [F.lit(default)]
    return rows.drop("label", "note").join(given, "id", "left").withColumn("label", F.coalesce(*choice)).withColumn("note", F.coalesce("_hand.note", F.lit(""))).drop("_hand")


def template_exemplars(rows: DataFrame, order: str = "id") -> DataFrame:
    """(template_group, exemplar_id, exemplar, n): the first message of each template."""
    return rows.groupBy("template_group").agg(F.min_by(F.struct("id", "text"), order).alias("e"), F.count("*").alias("n")).select("template_group", F.col("e.id").alias("exemplar_id"), F.col("e.text").alias("exemplar"), "n")


def label_by_template(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the label of their template (template_group, label), else NEEDS_REVIEW."""
    named = labels.groupBy("template_group").agg(F.max("label").alias("_label"))
    return rows.join(named, "template_group", "left").withColumn("label", F.coalesce("_label", F.lit(NEEDS_REVIEW))).select(*rows.columns)


def template_coverage(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(template_group, state): ``missing`` in the labels, or ``extra`` there."""
    have, want = labels.select("template_group").distinct(), rows.select("template_group").distinct()
    return want.join(have, "template_group", "left_anti").withColumn("state", F.lit("missing")).union(have.join(want, "template_group", "left_anti").withColumn("state", F.lit("extra")))


def prediction_join(rows: DataFrame, predictions: DataFrame, missing: str = "AD", order: str = "seq") -> DataFrame:
    """``rows`` with predicted (the last of each id, else ``missing``) and filled (whether it was missing)."""
    last = predictions.groupBy("id").agg(F.max_by("predicted", order).alias("_predicted"))
    return rows.join(last, "id", "left").withColumn("predicted", F.coalesce("_predicted", F.lit(missing))).withColumn("filled", F.col("_predicted").isNull()).drop("_predicted")


def soft_labels(rows: DataFrame, logits: DataFrame, temperature: float = 2.0) -> DataFrame:
    """``rows`` with soft: softmax of the teacher's logits over ``temperature``; missing logits are zeros."""
    joined = rows.join(logits.select("id", "logits"), "id", "left").withColumn("logits", F.coalesce("logits", F.array(*(F.lit(0.0) for _ in LABELS))))
    top = F.array_max("logits")
    powers = F.transform("logits", lambda x: F.exp((x - top) / temperature))
    mass = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return joined.withColumn("soft", F.transform(powers, lambda p: p / mass)).drop("logits")


def annotation_to_message(rows: DataFrame, language: str = "en", source: str = "annotation", *keep: str) -> DataFrame:
    """Annotated rows as message records: a trainable label, a text and an id are needed; blanks fall back."""

    def given(column: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.trim(F.coalesce(column, F.lit(""))), F.lit("")), default)

    label = F.upper(F.trim(F.coalesce("label", F.lit(""))))
    out = rows.select(
        F.trim(F.coalesce("id", F.lit(""))).alias("id"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), label.alias("label"), given("language", F.lit(language)).alias("language"),
        given("source", F.lit(source)).alias("source"), F.concat(F.lit("snd-ann-"), F.trim(F.col("id"))).alias("sender_group"), given("template_group", F.concat(F.lit("tpl-"), F.trim(F.col("id")))).alias("template_group"),
        F.array(given("annotator", F.lit("annotator"))).alias("annotator_ids"), *keep,
    )
    return out.filter(F.col("label").isin(*LABELS) & (F.col("id") != "") & (F.col("text") != ""))


def merge_packs(packs: Sequence[DataFrame], language: str = "en", source: str = "annotation") -> DataFrame:
    """Message records of annotation packs (id, ..., seq) in one table: of an id the first in pack order, then ``seq``, wins.

    Rows that no model can be trained on are left out. pack is the number of the pack that a record comes from.
    """
    every = None
    for number, rows in enumerate(packs):
        kept = annotation_to_message(rows, language, source, "seq").withColumn("pack", F.lit(number))
        every = kept if every is None else every.unionByName(kept)
    whole = F.struct(*every.columns)
    return every.groupBy("id").agg(F.min_by(whole, F.struct("pack", "seq")).alias("_row")).select("_row.*")


def merge_report(packs: Sequence[DataFrame], merged: DataFrame) -> DataFrame:
    """(pack, n, kept, trainable): rows of each pack, those that the merge kept, and those that a model could be trained on."""
    out = None
    for number, rows in enumerate(packs):
        counts = rows.agg(F.count("*").alias("n")).crossJoin(annotation_to_message(rows).agg(F.count("*").alias("trainable"))).withColumn("pack", F.lit(number))
        out = counts if out is None else out.unionByName(counts)
    return out.join(merged.groupBy("pack").agg(F.count("*").alias("kept")), "pack", "left").select("pack", "n", F.coalesce("kept", F.lit(0)).alias("kept"), "trainable")


def validation_errors(rows: DataFrame) -> DataFrame:
    """(id, error): what is wrong with each message record, and ``duplicate id`` for every row beyond an id's first.

    Errors name the offending value, a missing one as None.
    """

    def bad(column: str, allowed: Sequence[str]) -> Column:
        return F.when(~F.coalesce(F.col(column), F.lit("")).isin(*allowed), F.concat(F.lit(f"invalid {column}: "), F.coalesce(F.col(column), F.lit("None"))))

    def required(column: str) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) == "", f"{column} is required")

    rest = (required(c) for c in ("source", "source_license", "sender_group", "template_group"))
    errors = F.array_compact(F.array(required("id"), required("text"), bad("label", LABELS), bad("language", LANGUAGES), bad("split", SPLITS), *rest))
    each = rows.select("id", F.explode(errors).alias("error"))
    again = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("_"))
    return each.union(again.select("id", F.concat(F.lit("duplicate id: "), "id").alias("error")))


def source_audit(sources: DataFrame) -> DataFrame:
    """(n_sources, n_synthetic, n_approved, missing_license, licenses, status) of a source manifest."""
    missing = F.count_if((F.coalesce("license", F.lit("")) == "") | (F.coalesce("id", F.lit("")) == ""))
    return sources.agg(
        F.count("*").alias("n_sources"), F.count_if("is_synthetic").alias("n_synthetic"), F.count_if("approved_for_git").alias("n_approved"), missing.alias("missing_license"),
        F.array_sort(F.collect_set(F.nullif("license", F.lit("")))).alias("licenses"), F.when(missing > 0, "WARN").otherwise("PASS").alias("status"),
    )
