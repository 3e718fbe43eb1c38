"""Labels, languages and record layouts of labelled messages."""

from __future__ import annotations

from pyspark.sql import types as T

LABELS = ("TRANSACTION", "AD", "HARASS", "FRAUD")  # trainable, in model order
NEEDS_REVIEW = "NEEDS_REVIEW"
SPLITS = ("train", "validation", "test")
LANGUAGES = ("zh", "en", "hi", "id")

_TEXT = ("id", "text", "label", "language", "source", "source_license", "sender_group", "template_group", "split")

MESSAGE = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField("is_synthetic", T.BooleanType()), T.StructField("is_adversarial", T.BooleanType()), T.StructField("parent_id", T.StringType()), T.StructField("annotator_ids", T.ArrayType(T.StringType()))]
)

ANNOTATION_FIELDS = ("id", "text", "language", "source", "orig_label", "suggested_label", "suggest_reason", "label", "annotator", "template_group", "notes")
ANNOTATION = T.StructType([T.StructField(c, T.StringType()) for c in ANNOTATION_FIELDS])
CORRECTION = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "old", "new", "reason", "source")] + [T.StructField("priority", T.IntegerType()), T.StructField("seq", T.LongType())])
