"""The query over the pattern cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import pattern_cascade as P
from textloom.plans.text_queries import probe_rows, probes
from textloom.plans.views import query

WORDS = (("won cash", "call 12345 prize", "unredeemed points", "congratulations won", "urgent call", "ringtone", "line rental", "auction", "free text", "horny", "inner tigress", "free entry", "txt 80082", "stop 80082", "important 87121", "plain", "pharmacy", "massage baby oil", "camcorder free", "dating service", "collect content", "holiday call", "talk", "later"),)


def hit(pattern: str) -> str:
    return "regexp_matches(t, '" + pattern.replace("'", "''") + "')"


def why(pairs) -> str:
    return "CASE " + " ".join(f"WHEN {hit(p)} THEN '{r}'" for p, r in pairs[:-1]) + f" ELSE '{pairs[-1][1]}' END"


LISTS = [("|".join(f"(?:{p})" for p in patterns), label, why(reasons)) for patterns, label, reasons in ((P.FRAUD, "FRAUD", P.FRAUD_REASONS), (P.HARASS, "HARASS", P.HARASS_REASONS), (P.AD, "AD", P.AD_REASONS))]
LABEL = " ".join(f"WHEN {hit(p)} THEN '{x}'" for p, x, _ in LISTS) + " " + " ".join(f"WHEN orig = 'spam' AND {hit(p)} THEN '{x}'" for p, x, _ in P.SPAM)
REASON = " ".join(f"WHEN {hit(p)} THEN {r}" for p, _, r in LISTS) + " " + " ".join(f"WHEN orig = 'spam' AND {hit(p)} THEN '{r}'" for p, _, r in P.SPAM)


@query("cascade_pattern", f"SELECT msg_id, CASE {LABEL} ELSE 'NEEDS_REVIEW' END AS label, CASE {REASON} ELSE '{P.TALK}' END AS reason FROM {probes(WORDS)} WHERE t IS NOT NULL", "messages")
def cascade_pattern(spark, d):
    return probe_rows(spark, d, WORDS).select("msg_id", P.pattern_cascade(F.col("t"), F.col("orig") == "spam").alias("s")).select("msg_id", "s.label", "s.reason")
