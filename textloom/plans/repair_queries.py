"""Queries over the repair of English labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import repair
from textloom.plans.text_queries import probe_rows, probes
from textloom.plans.views import query

WORDS = (("caller tune", "secret admirer", "sexy", "you have won", "ringtone", "lol", "dinner", "live sex video", "plain", "reply stop", "cash prize", "horny", "otp", "tracking number", "discount", "naked"),)
LABEL = "CASE msg_id % 5 WHEN 0 THEN 'TRANSACTION' WHEN 1 THEN 'AD' WHEN 2 THEN 'HARASS' WHEN 3 THEN 'FRAUD' ELSE 'NEEDS_REVIEW' END"
ROWS = f"(SELECT msg_id, t, orig = 'spam' AS spam, {LABEL} AS label FROM {probes(WORDS)} WHERE t IS NOT NULL)"


def rows(spark, d):
    return probe_rows(spark, d, WORDS).withColumn("spam", F.expr("orig = 'spam'")).withColumn("label", F.expr(LABEL))


def like(pattern: str) -> str:
    return "regexp_matches(t, '" + pattern.replace("'", "''") + "', 'is')"


PRIZE, ADULT, PROMO = like(repair.EN_PRIZE), like(repair.EN_ADULT), like(repair.EN_PROMO)
GREY = f"(spam AND (contains(t, 'secret admirer') OR {ADULT}))"
TOO = f"({GREY} AND {PRIZE} AND NOT contains(t, 'secret admirer'))"
DECISIONS = [
    (f"{like(repair.EN_CALLER_TUNE)} AND label <> 'TRANSACTION'", "TRANSACTION", "callertune-service-result"), (f"{TOO} AND label <> 'FRAUD'", "FRAUD", "adult-text-but-prize-fraud"),
    (f"{GREY} AND NOT {TOO} AND label <> 'HARASS'", "HARASS", "adult-or-secret-admirer"), (f"{like(repair.EN_ADULT_BRAND)} AND label <> 'HARASS'", "HARASS", "adult-brand"),
    (f"{PRIZE} AND label IN ('NEEDS_REVIEW', 'AD', 'HARASS')", "FRAUD", "prize-claim-fraud"), (f"{PRIZE}", None, ""), (f"label = 'FRAUD' AND {PROMO}", "AD", "commercial-promo-not-fraud"),
    (f"NOT spam AND label IN ('AD', 'FRAUD', 'HARASS') AND {like(repair.EN_PERSONAL)} AND NOT {ADULT} AND NOT {PROMO}", "NEEDS_REVIEW", "ham-personal-forced"),
]


@query("repair_en_v1", "SELECT msg_id, CASE " + " ".join(f"WHEN {p} THEN " + (f"'{x}'" if x else "NULL") for p, x, _ in DECISIONS) + " END AS label, CASE " + " ".join(f"WHEN {p} THEN '{r}'" for p, _, r in DECISIONS) + f" ELSE '' END AS reason FROM {ROWS}", "messages")
def repair_en_v1(spark, d):
    decided = repair.repair_en(F.col("t"), F.col("label"), F.col("spam"))
    return rows(spark, d).select("msg_id", decided.alias("d")).select("msg_id", "d.label", "d.reason")


HARD, PROMO2, PRIZE2 = like(repair.EN2_HARD_PRIZE), like(repair.EN2_PROMO), like(repair.EN2_PRIZE)
LEFT = "spam AND label = 'NEEDS_REVIEW'"
SECOND = [
    ("NOT spam AND label IN ('AD', 'FRAUD', 'HARASS')", "NEEDS_REVIEW", "ham-not-four-class"), (f"label = 'FRAUD' AND {PROMO2} AND NOT {HARD}", "AD", "commercial-promo-not-fraud"),
    (f"label = 'FRAUD' AND {like(repair.EN2_TONE_OR_QUIZ)} AND NOT {like(repair.EN2_STATEMENT)}", "AD", "ringtone-quiz-auction-ad"),
    (f"{LEFT} AND (contains(t, 'secret admirer') OR {like(repair.EN2_ADULT)} OR {like('xxxmobilemovieclub|live sex')})", "HARASS", "spam-adult-dating"),
    (f"{LEFT} AND {PRIZE2} AND {PROMO2} AND NOT {HARD} AND {like(repair.EN2_TONE)}", "AD", "spam-review-to-ad"), (f"{LEFT} AND ({HARD} OR {PRIZE2})", "FRAUD", "spam-review-to-fraud"),
    (f"{LEFT} AND ({PROMO2} OR contains(t, 'barbie'))", "AD", "spam-review-to-ad"), (LEFT, "AD", "spam-review-default-ad"),
]


@query("repair_en_v2", "SELECT msg_id, CASE " + " ".join(f"WHEN {p} THEN '{x}'" for p, x, _ in SECOND) + " END AS label, CASE " + " ".join(f"WHEN {p} THEN '{r}'" for p, _, r in SECOND) + f" ELSE '' END AS reason FROM {ROWS}", "messages")
def repair_en_v2(spark, d):
    decided = repair.repair_en_second(F.col("t"), F.col("label"), F.col("spam"))
    return rows(spark, d).select("msg_id", decided.alias("d")).select("msg_id", "d.label", "d.reason")
