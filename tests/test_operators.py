"""Literal cases: encoder, normalizer, schema, leakage, metrics, rules and routing."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import classify as C
from textloom.operators import dedupe, labels, metrics, splits
from textloom.schema import LABELS


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_encoder(spark):
    assert one(spark, T.encode_bytes, "abc")[:4] == [98, 99, 100, 0]
    assert one(spark, T.encode_bytes, "") == [0] * 512 and one(spark, T.encode_bytes, None) == [0] * 512
    assert one(spark, T.encode_bytes, "a" * 600) == [98] * 512
    long = "a" * 383 + "é" + "b" * 300  # the cut falls inside a character
    raw = long.encode()
    assert one(spark, T.encode_bytes, long) == [b + 1 for b in raw[:384] + raw[-128:]]


def test_normalizer(spark):
    assert one(spark, T.normalize_text, "１２３") == "123"
    assert one(spark, T.normalize_text, "a​b   c　d ") == "ab c d"
    assert one(spark, T.normalize_text, None) == "" and one(spark, T.normalize_text, "​﻿") == ""
    assert one(spark, lambda c: T.normalize_text(c, confusables=True), "pаy 薇信 v信") == "pay 微信 微信"
    assert "ओटीपी" in one(spark, T.normalize_text, "OTP ओटीपी 1234")
    assert len(one(spark, T.normalize_text, "x" * 5000)) == 4096


def test_ngrams_of_short_texts(spark):
    assert one(spark, T.byte_ngrams, "") == [] and one(spark, T.byte_ngrams, "a") == [] and one(spark, T.byte_ngrams, "ab") == ["6162"]
    assert one(spark, T.byte_ngrams, "abc") == ["6162", "6263", "616263"]


def test_templates(spark):
    words = lambda c: T.template_group(c, "words")
    assert one(spark, words, "Code 123 for you") == one(spark, words, "code 98765, FOR you!")
    assert one(spark, lambda c: T.template_group(c, "zeros", F.lit("7")), " ") == "tpl-7"


def routed(spark, body, probs=None):
    frame = spark.createDataFrame([(body, probs)], "body string, p array<double>")
    return C.classify_messages(frame, probs="p").first()


@pytest.mark.parametrize(
    ("body", "category", "action", "reason"),
    [
        ("Your OTP: 123456", "TRANSACTION", "INBOX", "OTP_WITH_NEARBY_CODE"),
        ("验证码: 1234 请向安全账户转账", "FRAUD", "REVIEW", "OTP_FRAUD_CONFLICT"),
        ("请向安全账户转账", "FRAUD", "SUSPECT", "HIGH_FRAUD_RISK"),
        ("hello there", "AD", "REVIEW", "NO_MODEL_LOW_CONFIDENCE"),
        ("取件码 A1234", "TRANSACTION", "INBOX", "PICKUP_WITH_NEARBY_CODE"),
        (None, "AD", "REVIEW", "NO_MODEL_LOW_CONFIDENCE"),
    ],
)
def test_routing_by_rules(spark, body, category, action, reason):
    r = routed(spark, body)
    assert (r.category, r.action, r.reason) == (category, action, reason)


def test_routing_by_model(spark):
    assert routed(spark, "hello", [0.1, 0.2, 0.1, 0.6]).action == "REVIEW"
    sure = routed(spark, "hello", [0.0, 0.9, 0.05, 0.05])
    assert (sure.category, sure.action, sure.reason) == ("AD", "SUSPECT", "MODEL_PREDICTION")
    assert routed(spark, "special offer", [0.9, 0.1, 0.0, 0.0]).category == "TRANSACTION"
    logits = routed(spark, "x", [10.0, 0.0, 0.0, 0.0])
    assert logits.category == "TRANSACTION" and logits.confidence > 0.99
    assert routed(spark, "x", []).confidence == 0


def message(**change):
    row = {"id": "1", "text": "t", "label": "AD", "language": "en", "source": "s", "source_license": "l", "sender_group": "a", "template_group": "b", "split": "train", "parent_id": None}
    return row | change


FIELDS = "id string, text string, label string, language string, source string, source_license string, sender_group string, template_group string, split string, parent_id string"


def messages(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], FIELDS)


def test_validation(spark):
    found = labels.validation_errors(messages(spark, message(), message(label="SPAM", id="2"), message(id="2", text=""))).collect()
    assert sorted(map(tuple, found)) == [("2", "duplicate id: 2"), ("2", "invalid label: SPAM"), ("2", "text is required")]


def test_leakage(spark):
    def status(*rows):
        return {r.kind: (r.n, r.status) for r in splits.leakage_audit(messages(spark, *rows)).collect()}

    clean = status(message(), message(id="2", template_group="c", split="test"))
    assert clean["all"] == (0, "PASS")
    assert status(message(), message(id="2", split="test"))["group"] == (1, "FAIL")
    assert status(message(), message(template_group="c", split="test"))["id"] == (1, "FAIL")
    assert status(message(), message(id="3", template_group="c", split="test", parent_id="1"))["parent"] == (1, "FAIL")
    assert status(message(), message(id="2", sender_group="z", split="test"))["template_only"] == (1, "WARN")


def test_splits_are_disjoint_and_stable(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") % 60).cast("string").alias("g"))
    a = {r.id: r.split for r in splits.split_groups(rows, F.col("g")).collect()}
    b = {r.id: r.split for r in splits.split_groups(rows.repartition(9), F.col("g")).collect()}
    assert a == b and len(a) == 500
    groups = {}
    for i, s in a.items():
        assert groups.setdefault(int(i) % 60, s) == s
    assert sorted(list(groups.values()).count(s) for s in ("train", "validation", "test")) == [6, 6, 48]
    with pytest.raises(ValueError):
        splits.split_groups(rows, F.col("g"), (0.5, 0.1, 0.1))


def test_wilson(spark):
    low, high = spark.range(1).select(metrics.wilson(F.lit(8), F.lit(10)).alias("w")).first()["w"]
    assert 0.44 < low < 0.5 and 0.9 < high < 0.95
    assert tuple(spark.range(1).select(metrics.wilson(F.lit(0), F.lit(0)).alias("w")).first()["w"]) == (0.0, 0.0)


def test_perfect_and_empty_metrics(spark):
    pairs = spark.createDataFrame([(x, x) for x in LABELS], "label string, predicted string")
    assert metrics.macro_f1(metrics.confusion_matrix(pairs)).first()["macro_f1"] == 1
    assert metrics.accuracy(pairs.limit(0)).first()["accuracy"] == 0


def test_dedupe_is_idempotent_and_keeps_the_first(spark):
    rows = spark.createDataFrame([(3, "a  b"), (1, "a b"), (2, None), (4, ""), (5, "a b")], "k long, text string")
    once = dedupe.dedupe_two_stage(rows, "text", "k")
    assert sorted(r.k for r in once.collect()) == [1, 2] == sorted(r.k for r in dedupe.dedupe_two_stage(once, "text", "k").collect())
    assert tuple(dedupe.dedupe_counts(rows, "text").first()) == (5, 2, 1)
    assert dedupe.dedupe_exact(rows.limit(0), "text", "k").count() == 0
