"""Queries over classification, metrics, audits and the result store."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import audits as A
from textloom.operators import classify as C
from textloom.operators import labels as L
from textloom.operators import manifest
from textloom.operators import metrics as M
from textloom.operators import splits as S
from textloom.operators.allowlist import allowed_by_act
from textloom.operators.heavy import most_frequent
from textloom.places import shared_folder
from textloom.plans.views import query, view
from textloom.schema import LABELS

BODY = r"trim(regexp_replace(body, '\s+', ' ', 'g'), ' ')"
MATCHES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({BODY}, '{r.pattern}', 'i') THEN '{r.id}' END" for r in C.rules_by_priority()) + "], lambda x: x IS NOT NULL)"
SIGNALS = f"""
s AS (SELECT msg_id, body, ids, {' OR '.join(f"list_contains(ids, '{r.id}')" for r in C.RULES if r.type == 'OTP_PROTECT')} AS otp,
  {' OR '.join(f"list_contains(ids, '{r.id}')" for r in C.RULES if r.type == 'FRAUD_RISK')} AS fraud, {' OR '.join(f"list_contains(ids, '{r.id}')" for r in C.RULES if r.type == 'PICKUP_PROTECT')} AS pickup,
  CASE ids[1] {' '.join(f"WHEN '{r.id}' THEN '{r.category}'" for r in C.RULES)} END AS hint, CASE ids[1] {' '.join(f"WHEN '{r.id}' THEN '{r.reason}'" for r in C.RULES)} ELSE 'NO_RULE_MATCH' END AS why
  FROM (SELECT msg_id, body, {MATCHES} AS ids FROM messages))"""
ROUTED = f"""{SIGNALS},
c AS (SELECT msg_id, array_to_string(ids, ',') AS rule_ids, CASE WHEN otp AND fraud THEN 'FRAUD' ELSE coalesce(hint, 'AD') END AS category,
  CASE WHEN otp AND fraud THEN 'REVIEW' WHEN otp THEN 'INBOX' WHEN hint IS NULL THEN 'REVIEW' WHEN fraud THEN 'SUSPECT' WHEN pickup OR hint = 'TRANSACTION' THEN 'INBOX' ELSE 'SUSPECT' END AS action,
  CASE WHEN hint IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN otp AND fraud THEN 'OTP_FRAUD_CONFLICT' WHEN hint IS NULL THEN 'NO_MODEL_LOW_CONFIDENCE' ELSE why END AS reason FROM s)"""


def normalized(spark, d):
    return view(spark, d, "messages").select("msg_id", T.normalize_text(F.col("body")).alias("normalized"))


@query("match_rules", f"SELECT msg_id, array_to_string({MATCHES}, ',') AS rule_ids FROM messages", "messages")
def match_rules(spark, d):
    return normalized(spark, d).select("msg_id", F.array_join(C.match_rules(F.col("normalized")), ",").alias("rule_ids"))


@query("rule_signals", f"WITH {SIGNALS} SELECT msg_id, otp AS has_otp, fraud AS has_fraud, pickup AS has_pickup, hint AS category_hint, CASE WHEN otp AND fraud THEN 'OTP_FRAUD_CONFLICT' ELSE why END AS reason FROM s", "messages")
def rule_signals(spark, d):
    ids = normalized(spark, d).select("msg_id", C.match_rules(F.col("normalized")).alias("ids"))
    return ids.select("msg_id", C.rule_signals(F.col("ids")).alias("s")).select("msg_id", "s.*")


@query("rule_hit_stats", f"SELECT rule_id, count(*) AS n FROM (SELECT unnest({MATCHES}) AS rule_id FROM messages) GROUP BY rule_id", "messages")
def rule_hit_stats(spark, d):
    return normalized(spark, d).select(F.explode(C.match_rules(F.col("normalized"))).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("classify_messages", f"WITH {ROUTED} SELECT * FROM c", "messages")
def classify_messages(spark, d):
    out = C.classify_messages(view(spark, d, "messages"))
    return out.select("msg_id", F.array_join("rule_ids", ",").alias("rule_ids"), "category", "action", "confidence", "reason")


RAW = "[(cust % 7)::DOUBLE, (cust % 5)::DOUBLE, (cust % 3)::DOUBLE, 1.0::DOUBLE]"
PROBS = f"(SELECT id, msg_id, text, cust, list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda w: exp(w - list_max(z))))) AS p FROM (SELECT *, {RAW} AS z FROM labelled))"


def scores(rows):
    return rows.withColumn("scores", F.array(*((F.col("cust") % k).cast("double") for k in (7, 5, 3)), F.lit(1.0)))


@query("softmax_probs", f"SELECT id, round(p[1], 9) AS p0, round(p[2], 9) AS p1, round(p[3], 9) AS p2, round(p[4], 9) AS p3 FROM (SELECT id, CASE WHEN list_sum({RAW}) BETWEEN 0.95 AND 1.05 THEN {RAW} ELSE p END AS p FROM {PROBS})", "labelled")
def softmax_probs(spark, d):
    p = scores(view(spark, d, "labelled")).select("id", C.softmax_probs(F.col("scores")).alias("p"))
    return p.select("id", *(F.round(F.get("p", F.lit(k)), 9).alias(f"p{k}") for k in range(4)))


@query("argmax_label", f"SELECT id, {list(LABELS)}[list_position({RAW}, list_max({RAW}))] AS label FROM labelled", "labelled")
def argmax_label(spark, d):
    return scores(view(spark, d, "labelled")).select("id", C.argmax_label(F.col("scores")).alias("label"))


@query("route_decision", f"""
WITH {SIGNALS},
m AS (SELECT id, msg_id, {list(LABELS)}[list_position({RAW}, list_max({RAW}))] AS best, CASE WHEN list_sum({RAW}) BETWEEN 0.95 AND 1.05 THEN list_max({RAW}) ELSE list_max(p) END AS top FROM {PROBS}),
j AS (SELECT m.id, s.*, best, top, CASE WHEN otp AND fraud THEN 'FRAUD' ELSE best END AS category FROM m JOIN s ON m.msg_id = s.msg_id),
u AS (SELECT *, top < CASE category WHEN 'TRANSACTION' THEN 0.55 WHEN 'FRAUD' THEN 0.75 ELSE 0.7 END AS unsure FROM j)
SELECT id, category, CASE WHEN otp AND fraud THEN 'REVIEW' WHEN otp THEN 'INBOX' WHEN unsure THEN 'REVIEW' WHEN category = 'TRANSACTION' THEN 'INBOX' ELSE 'SUSPECT' END AS action,
  CASE WHEN otp AND fraud THEN 'OTP_FRAUD_CONFLICT' WHEN unsure THEN 'MODEL_LOW_CONFIDENCE' WHEN why <> 'NO_RULE_MATCH' THEN why ELSE 'MODEL_PREDICTION' END AS reason FROM u""", "labelled")
def route_decision(spark, d):
    out = C.classify_messages(scores(view(spark, d, "labelled")), "text", "scores")
    return out.select("id", "category", "action", "reason")


@query("score_fallback", f"WITH {ROUTED} SELECT m.msg_id, coalesce(c.category, 'UNKNOWN') AS category, coalesce(c.action, 'REVIEW') AS action, coalesce(c.confidence, 0) AS confidence, coalesce(c.reason, 'TIMEOUT_OR_ERROR') AS reason FROM messages m LEFT JOIN (SELECT * FROM c WHERE msg_id % 9 <> 0) c ON m.msg_id = c.msg_id", "messages")
def score_fallback(spark, d):
    rows = view(spark, d, "messages").select("msg_id", "body")
    results = C.classify_messages(rows.filter("msg_id % 9 <> 0")).select("msg_id", "category", "action", "confidence", "reason")
    return C.score_fallback(rows, results, "msg_id").drop("body")


@query("batch_eval", f"WITH {ROUTED} SELECT count(*) AS total, count(*) FILTER (l.label <> 'NEEDS_REVIEW') AS labelled, count(*) FILTER (l.label = c.category) AS correct, round(count(*) FILTER (l.label = c.category) / count(*) FILTER (l.label <> 'NEEDS_REVIEW'), 9) AS accuracy FROM c JOIN labelled l ON l.msg_id = c.msg_id", "labelled")
def batch_eval(spark, d):
    out = C.classify_messages(view(spark, d, "labelled"), "text")
    known, right = F.count_if(F.col("label") != "NEEDS_REVIEW"), F.count_if(F.col("label") == F.col("category"))
    return out.agg(F.count("*").alias("total"), known.alias("labelled"), right.alias("correct"), F.round(right / known, 9).alias("accuracy"))


@query("redacted_report", f"WITH {ROUTED} SELECT c.msg_id, length(body) AS body_length, true AS body_redacted, category, action, reason FROM c JOIN messages m ON c.msg_id = m.msg_id", "messages")
def redacted_report(spark, d):
    out = C.classify_messages(view(spark, d, "messages"))
    return out.select("msg_id", F.length("body").cast("long").alias("body_length"), F.lit(True).alias("body_redacted"), "category", "action", "reason")


@query("dense_training_rows", r"""
WITH h AS (SELECT id, label, hex(encode(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))) AS h FROM labelled WHERE label <> 'NEEDS_REVIEW')
SELECT id, md5(array_to_string(list_transform(range(0, 512), lambda i: CASE WHEN 2 * i < length(h) THEN ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::INT + 1 ELSE 0 END), ',')) AS ids,
  list_position(['TRANSACTION', 'AD', 'HARASS', 'FRAUD'], label) - 1 AS label_index FROM h""", "labelled")
def dense_training_rows(spark, d):
    rows = view(spark, d, "labelled")
    at = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col("label")).cast("int") - 1
    return L.trainable(rows).select("id", F.md5(F.array_join(T.encode_bytes(T.normalize_text(F.col("text"))).cast("array<string>"), ",")).alias("ids"), at.alias("label_index"))


GRAMS = "(SELECT id, label, unnest(list_concat(list_transform(range(0, length(h) // 2 - 1), lambda i: substr(h, (2 * i + 1)::BIGINT, 4)), list_transform(range(0, length(h) // 2 - 2), lambda i: substr(h, (2 * i + 1)::BIGINT, 6)))) AS gram FROM (SELECT id, label, lower(hex(encode(text))) AS h FROM labelled))"
VOCAB = f"(SELECT gram, count(*) AS n FROM {GRAMS} GROUP BY gram ORDER BY n DESC, gram LIMIT 4096)"


def vocabulary(rows, size: int = 4096):
    """The most frequent byte n-grams, ties by gram: a fixed number of rows."""
    return T.ngram_totals(rows, "text").orderBy(F.desc("n"), "gram").limit(size)


@query("ngram_vocab", f"SELECT gram, n FROM {VOCAB}", "labelled")
def ngram_vocab(spark, d):
    return vocabulary(view(spark, d, "labelled"))


@query("ngram_vocab_sketch", f"SELECT gram, n FROM {VOCAB}", "labelled")
def ngram_vocab_sketch(spark, d):
    """The same vocabulary from a sketch of bounded size and a recount of its candidates."""
    rows = view(spark, d, "labelled")
    top = most_frequent(T.ngram_rows(rows, F.col("text")), "gram", 4096, totals=T.ngram_totals(rows, "text", parts=True))
    return top.select(F.col("value").alias("gram"), F.col("count").alias("n"))


@query("ngram_vectorize", f"SELECT id, gram, count(*) AS n FROM {GRAMS} WHERE gram IN (SELECT gram FROM {VOCAB}) GROUP BY id, gram", "labelled")
def ngram_vectorize(spark, d):
    rows = view(spark, d, "labelled")
    return T.ngram_counts(rows, "text", "id", vocabulary(rows))


PAIRS = "(SELECT l.id, l.label, l.language, coalesce(p.predicted, 'AD') AS predicted, p.predicted IS NULL AS filled FROM labelled l LEFT JOIN predictions p ON l.id = p.id WHERE l.label <> 'NEEDS_REVIEW')"
GRID = f"(SELECT a.label, b.label AS predicted FROM (SELECT unnest({list(LABELS)}) AS label) a, (SELECT unnest({list(LABELS)}) AS label) b)"
MATRIX = f"(SELECT g.label, g.predicted, count(p.id) AS n FROM {GRID} g LEFT JOIN {PAIRS} p ON p.label = g.label AND p.predicted = g.predicted GROUP BY ALL)"
CLASS = f"""(SELECT a.label, a.support, CASE WHEN b.said > 0 THEN a.hit / b.said ELSE 0 END AS p, CASE WHEN a.support > 0 THEN a.hit / a.support ELSE 0 END AS r
FROM (SELECT label, sum(n)::BIGINT AS support, sum(n) FILTER (label = predicted) AS hit FROM {MATRIX} GROUP BY label) a JOIN (SELECT predicted, sum(n) AS said FROM {MATRIX} GROUP BY predicted) b ON a.label = b.predicted)"""


def pairs(spark, d):
    return L.prediction_join(L.trainable(view(spark, d, "labelled")), view(spark, d, "predictions"))


@query("confusion_matrix", f"SELECT * FROM {MATRIX}", "labelled", "predictions")
def confusion_matrix(spark, d):
    return M.confusion_matrix(pairs(spark, d))


@query("per_class_prf", f"SELECT label, support, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM {CLASS}", "labelled", "predictions")
def per_class_prf(spark, d):
    out = M.per_class(M.confusion_matrix(pairs(spark, d)))
    return out.select("label", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("macro_f1", f"SELECT round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / 4, 9) AS macro_f1 FROM {CLASS}", "labelled", "predictions")
def macro_f1(spark, d):
    return M.macro_f1(M.confusion_matrix(pairs(spark, d))).select(F.round("macro_f1", 9).alias("macro_f1"))


@query("accuracy", f"SELECT count(*) AS n, round(avg((label = predicted)::INT), 9) AS accuracy FROM {PAIRS}", "labelled", "predictions")
def accuracy(spark, d):
    return M.accuracy(pairs(spark, d)).select("n", F.round("accuracy", 9).alias("accuracy"))


@query("wilson_interval", f"""
WITH c AS (SELECT language, count(*)::DOUBLE AS n, avg((label = predicted)::INT) AS p FROM {PAIRS} GROUP BY language)
SELECT language, round(greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 9) AS low,
  round(least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 9) AS high FROM c""", "labelled", "predictions")
def wilson_interval(spark, d):
    sums = pairs(spark, d).groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("hit"))
    w = sums.select("language", M.wilson(F.col("hit"), F.col("n")).alias("w"))
    return w.select("language", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


@query("metrics_by_language", f"""
WITH g AS (SELECT x.language, g.label, g.predicted, count(p.id) AS n FROM (SELECT DISTINCT language FROM {PAIRS}) x CROSS JOIN {GRID} g LEFT JOIN {PAIRS} p ON p.language = x.language AND p.label = g.label AND p.predicted = g.predicted GROUP BY ALL),
a AS (SELECT language, label, sum(n) AS support, sum(n) FILTER (label = predicted) AS hit FROM g GROUP BY ALL), b AS (SELECT language, predicted AS label, sum(n) AS said FROM g GROUP BY ALL),
f AS (SELECT language, CASE WHEN support + said > 0 THEN 2 * hit / (support + said) ELSE 0 END AS f1 FROM a JOIN b USING (language, label)),
t AS (SELECT language, count(*) AS n, avg((label = predicted)::INT) AS accuracy FROM {PAIRS} GROUP BY language)
SELECT t.language, any_value(t.n) AS n, round(any_value(t.accuracy), 9) AS accuracy, round(sum(f1) / 4, 9) AS macro_f1 FROM t JOIN f USING (language) GROUP BY t.language""", "labelled", "predictions")
def metrics_by_language(spark, d):
    return M.metrics_by(pairs(spark, d), "language").select("language", "n", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query("evaluation_report", f"""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (filled) AS filled, avg((label = predicted)::INT) AS accuracy, count(*) FILTER (label = 'TRANSACTION' AND predicted = 'TRANSACTION') AS hit, count(*) FILTER (label = 'TRANSACTION') AS wanted, count(*) FILTER (predicted = 'TRANSACTION') AS said FROM {PAIRS})
SELECT n, filled, round(accuracy, 9) AS accuracy, round(hit / wanted, 9) AS recall, round(hit / said, 9) AS precision FROM c""", "labelled", "predictions")
def evaluation_report(spark, d):
    return M.transaction_report(pairs(spark, d)).select("n", "filled", *(F.round(c, 9).alias(c) for c in ("accuracy", "recall", "precision")))


@query("prediction_distribution", f"SELECT predicted, count(*) AS n FROM {PAIRS} GROUP BY predicted", "labelled", "predictions")
def prediction_distribution(spark, d):
    return A.distribution(pairs(spark, d), "predicted")


@query("collapse_gate", f"SELECT count(*) AS n, count(DISTINCT predicted) AS n_classes, CASE WHEN count(DISTINCT predicted) = 1 AND count(*) >= 8 THEN 'FAIL' ELSE 'PASS' END AS status FROM {PAIRS}", "labelled", "predictions")
def collapse_gate(spark, d):
    return M.collapse_gate(pairs(spark, d))


@query("class_weights", "WITH c AS (SELECT label, count(*) AS n FROM labelled WHERE label <> 'NEEDS_REVIEW' GROUP BY label) SELECT label, round((SELECT sum(n) FROM c) / (4 * n), 9) AS weight FROM c", "labelled")
def class_weights(spark, d):
    return M.class_weights(view(spark, d, "labelled")).select("label", F.round("weight", 9).alias("weight"))


@query("prediction_agreement", f"SELECT count(*) AS n, round(avg((list_position(z, list_max(z)) = list_position(y, list_max(y)))::INT), 9) AS agreement, CASE WHEN avg((list_position(z, list_max(z)) = list_position(y, list_max(y)))::INT) >= 0.99 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT {RAW} AS z, [(cust % 7)::DOUBLE, (cust % 5)::DOUBLE, (cust % 4)::DOUBLE, 1.0::DOUBLE] AS y FROM labelled)", "labelled")
def prediction_agreement(spark, d):
    rows = view(spark, d, "labelled")
    a = scores(rows).select("id", F.col("scores").alias("probs"))
    b = rows.select("id", F.array(*((F.col("cust") % k).cast("double") for k in (7, 5, 4)), F.lit(1.0)).alias("probs"))
    return M.prediction_agreement(a, b, "id").withColumn("agreement", F.round("agreement", 9))


@query("prediction_agreement_topped_up", f"""
WITH a AS (SELECT id, cust, row_number() OVER (ORDER BY msg_id % 10 < 9, id) AS k, count(*) FILTER (msg_id % 10 = 9) OVER () AS held FROM labelled),
b AS (SELECT {RAW} AS z, [(cust % 7)::DOUBLE, (cust % 5)::DOUBLE, (cust % 4)::DOUBLE, 1.0::DOUBLE] AS y FROM a WHERE k <= greatest(held, 1000))
SELECT count(*) AS n, round(avg((list_position(z, list_max(z)) = list_position(y, list_max(y)))::INT), 9) AS agreement FROM b""", "labelled")
def prediction_agreement_topped_up(spark, d):
    """A test set of a tenth, topped up from the rest to 1,000 rows where it is smaller."""
    rows = view(spark, d, "labelled")
    checked = M.topped_up(rows.filter("msg_id % 10 = 9"), rows.filter("msg_id % 10 < 9"), "id", 1000)
    a = scores(checked).select("id", F.col("scores").alias("probs"))
    b = checked.select("id", F.array(*((F.col("cust") % k).cast("double") for k in (7, 5, 4)), F.lit(1.0)).alias("probs"))
    return M.prediction_agreement(a, b, "id").select("n", F.round("agreement", 9).alias("agreement"))


@query("latency_over_time", """
WITH s AS (SELECT event_type, sign(value)::INT AS s, CASE WHEN value <> 0 THEN ceil(ln(abs(value)) / ln(1.01::DOUBLE / 0.99::DOUBLE)) ELSE 0 END AS b, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL),
v AS (SELECT *, s * 2 * pow(1.01::DOUBLE / 0.99::DOUBLE, b) / (1.01::DOUBLE / 0.99::DOUBLE + 1) AS v FROM s),
u AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY v) AS upto, sum(c) OVER (PARTITION BY event_type) AS n FROM v)
SELECT event_type, max(n)::BIGINT AS n, round(min(v) FILTER (upto > floor((n - 1) * 0.5)), 6) AS p50, round(min(v) FILTER (upto > floor((n - 1) * 0.95)), 6) AS p95, round(min(v) FILTER (upto > floor((n - 1) * 0.99)), 6) AS p99 FROM u GROUP BY event_type""")
def latency_over_time(spark, d):
    """Sketches of each hour and action, written and merged over the whole span."""
    folder = shared_folder(spark, "sketches")
    M.quantile_buckets(view(spark, d, "events"), "ts", "value", "event_type").write.parquet(folder)
    return M.merged_quantiles(spark.read.parquet(folder), "event_type").select("event_type", "n", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")))


@query("latency_summary", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT max(n) AS n, max(value) FILTER (k = floor((n - 1) * 0.5)) AS p50, max(value) FILTER (k = floor((n - 1) * 0.95)) AS p95, max(value) FILTER (k = floor((n - 1) * 0.99)) AS p99 FROM r")
def latency_summary(spark, d):
    return M.latency_summary(view(spark, d, "events"), "value")


def gate_sql(name: str, where: str) -> str:
    """(r, f): recall of TRANSACTION and macro F1 of the pairs that ``where`` leaves, as a table of one row."""
    one = "2 * count(*) FILTER (label = '{0}' AND predicted = '{0}') / nullif(count(*) FILTER (label = '{0}') + count(*) FILTER (predicted = '{0}'), 0)"
    f1 = " + ".join(f"coalesce({one.format(x)}, 0)" for x in LABELS)
    return f"{name} AS (SELECT count(*) FILTER (label = 'TRANSACTION' AND predicted = 'TRANSACTION') / count(*) FILTER (label = 'TRANSACTION') AS r, ({f1}) / 4 AS f FROM {PAIRS} WHERE {where})"


@query("metric_budget_gate", f"""
WITH {gate_sql('b', 'true')}, {gate_sql('c', "language <> 'zh'")}
SELECT round(b.r - c.r, 9) AS recall_drop, round(b.f - c.f, 9) AS f1_drop, CASE WHEN b.r - c.r <= 0.005 AND b.f - c.f <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status FROM b, c""", "labelled", "predictions")
def metric_budget_gate(spark, d):
    def row(p):
        return M.transaction_report(p).select(F.col("recall").alias("transaction_recall")).crossJoin(M.macro_f1(M.confusion_matrix(p)))

    rows = pairs(spark, d)
    return M.budget_gate(row(rows.filter("language <> 'zh'")), row(rows)).select(F.round("recall_drop", 9).alias("recall_drop"), F.round("f1_drop", 9).alias("f1_drop"), "status")


@query("label_distribution", "SELECT language, label, source, count(*) AS n FROM labelled GROUP BY ALL", "labelled")
def label_distribution(spark, d):
    return A.distribution(view(spark, d, "labelled"), "language", "label", "source")


@query("pack_pools", "SELECT language, source, count(*) FILTER (label <> 'NEEDS_REVIEW') AS trainable, count(*) FILTER (label = 'NEEDS_REVIEW') AS review FROM labelled GROUP BY ALL", "labelled")
def pack_pools(spark, d):
    review = F.col("label") == "NEEDS_REVIEW"
    return view(spark, d, "labelled").groupBy("language", "source").agg(F.count_if(~review).alias("trainable"), F.count_if(review).alias("review"))


@query("template_label_conflicts", "SELECT template_group AS key, count(*) AS n, count(DISTINCT label) AS n_labels FROM packs GROUP BY template_group HAVING count(DISTINCT label) > 1", "packs")
def template_label_conflicts(spark, d):
    return A.conflicts(view(spark, d, "packs"), F.col("template_group"))


@query("text_label_conflicts", "SELECT sha256(trim(text)) AS key, count(*) AS n, count(DISTINCT label) AS n_labels FROM packs GROUP BY trim(text) HAVING count(DISTINCT label) > 1", "packs")
def text_label_conflicts(spark, d):
    return A.conflicts(view(spark, d, "packs"), F.sha2(F.trim("text"), 256))


@query("label_transition_matrix", "SELECT orig_label, label, count(*) AS n FROM packs GROUP BY ALL", "packs")
def label_transition_matrix(spark, d):
    return A.distribution(view(spark, d, "packs"), "orig_label", "label")


@query("suggestion_agreement", "SELECT pack, count(*) AS n, round(avg((suggested_label = label)::INT), 9) AS agreement FROM packs GROUP BY pack", "packs")
def suggestion_agreement(spark, d):
    return view(spark, d, "packs").groupBy("pack").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("suggested_label") == F.col("label"), 1.0).otherwise(0.0)), 9).alias("agreement"))


@query("forced_rates", "SELECT round(avg((label = 'NEEDS_REVIEW')::INT) FILTER (orig_label <> 'TRANSACTION'), 9) AS spam_in_review, round(avg((label <> 'NEEDS_REVIEW')::INT) FILTER (orig_label = 'TRANSACTION'), 9) AS ham_forced FROM packs", "packs")
def forced_rates(spark, d):
    out = A.forced_rates(view(spark, d, "packs"), F.col("orig_label") != "TRANSACTION")
    return out.select(F.round("spam_in_review", 9).alias("spam_in_review"), F.round("ham_forced", 9).alias("ham_forced"))


@query("pack_profile", "SELECT pack, count(*) AS n, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x.lower()}" for x in (*LABELS, "NEEDS_REVIEW")) + ", round(avg((label = 'NEEDS_REVIEW')::INT), 9) AS review_share, count(*) FILTER (contains(notes, '[fix:')) AS n_fixed, count(DISTINCT annotator) AS n_annotators FROM packs GROUP BY pack", "packs")
def pack_profile(spark, d):
    return A.pack_profile(view(spark, d, "packs")).withColumn("review_share", F.round("review_share", 9))


ROW = "sha256(id || chr(31) || text || chr(31) || label)"


@query("dataset_manifest", f"""
WITH a AS (SELECT split, {ROW} AS h, count(*) AS c FROM splits GROUP BY ALL),
b AS (SELECT split, left(h, 4) AS b, sum(c) AS n, sha256(array_to_string(list_sort(list(h || ':' || c)), ',')) AS h FROM a GROUP BY split, left(h, 4)),
c AS (SELECT split, left(b, 2) AS b, sum(n) AS n, sha256(array_to_string(list_sort(list(b || ':' || h)), ',')) AS h FROM b GROUP BY split, left(b, 2))
SELECT split, sum(n)::BIGINT AS n, sha256(array_to_string(list_sort(list(b || ':' || h)), ',')) AS content_hash FROM c GROUP BY split""", "splits")
def dataset_manifest(spark, d):
    return A.content_manifest(view(spark, d, "splits"), "id", "text", "label")


@query("manifest_changes", """
WITH a AS (SELECT split, sha256(id || chr(31) || text || chr(31) || label) AS h, count(*) AS n FROM splits GROUP BY ALL),
b AS (SELECT split, sha256(id || chr(31) || text || chr(31) || label) AS h, count(*) AS n FROM (SELECT split, id, CASE WHEN hash THEN text || '!' ELSE text END AS text, label FROM (SELECT *, right(id, 2) = '33' AS hash FROM splits) WHERE right(id, 3) <> '777') GROUP BY ALL)
SELECT split, h, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after FROM a FULL JOIN b USING (split, h) WHERE a.n IS DISTINCT FROM b.n""", "splits")
def manifest_changes(spark, d):
    """Two versions of the splits, one with changed and missing rows: which rows differ, from their stored trees."""
    before, columns = view(spark, d, "splits").select("split", "id", "text", "label"), ("id", "text", "label")
    after = before.filter(F.right("id", F.lit(3)) != "777").withColumn("text", F.when(F.right("id", F.lit(2)) == "33", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    trees = []
    for rows in (before, after):
        folder = shared_folder(spark, "manifest")
        manifest.tree(manifest.leaves(rows, *columns)).write.parquet(folder)
        trees.append(spark.read.parquet(folder))
    return manifest.differing_rows(before, after, manifest.differing(*trees), *columns)


@query("queue_view", "SELECT s.message_uri, s.action, s.created_at, m.body FROM store s JOIN messages m ON s.message_uri = m.msg_id WHERE s.action = 'REVIEW'", "store")
def queue_view(spark, d):
    return A.queue_view(view(spark, d, "store"), view(spark, d, "messages"), ("REVIEW",)).select("message_uri", "action", "created_at", "body")


@query("inbox_view", "SELECT msg_id FROM messages WHERE msg_id NOT IN (SELECT message_uri FROM store WHERE action IN ('SUSPECT', 'REVIEW'))", "store")
def inbox_view(spark, d):
    return A.inbox_view(view(spark, d, "messages"), view(spark, d, "store")).select("msg_id")


@query("restore_to_inbox", "SELECT message_uri, CASE WHEN message_uri % 8 = 0 THEN 'INBOX' ELSE action END AS action FROM store", "store")
def restore_to_inbox(spark, d):
    store = view(spark, d, "store")
    return A.restore_to_inbox(store, store.filter("message_uri % 8 = 0")).select("message_uri", "action")


@query("classification_upsert", """
SELECT message_uri, action, created_at FROM store WHERE message_uri % 3 <> 0
UNION ALL SELECT msg_id, 'REVIEW', msg_id * 1000 + 1 FROM labelled WHERE msg_id % 3 = 0""", "store")
def classification_upsert(spark, d):
    store = view(spark, d, "store").select("message_uri", "action", "created_at")
    changes = view(spark, d, "labelled").filter("msg_id % 3 = 0").select(F.col("msg_id").alias("message_uri"), F.lit("REVIEW").alias("action"), (F.col("msg_id") * 1000 + 1).alias("created_at"))
    return A.upsert(store, changes, "message_uri", "created_at")


@query("recent_messages", "SELECT msg_id, ts FROM messages ORDER BY ts DESC, msg_id LIMIT 200", "messages")
def recent_messages(spark, d):
    return view(spark, d, "messages").select("msg_id", "ts").orderBy(F.desc("ts"), "msg_id").limit(200)


@query("adversarial_slices", "SELECT id || '-' || s AS id, id AS parent_id, s AS slice, CASE s WHEN 'clean' THEN text WHEN 'known' THEN replace(text, ' ', chr(8203) || ' ') ELSE translate(replace(replace(text, '微', '薇'), '信', '伈'), 'aeo', '@30') END AS text FROM labelled, (SELECT unnest(['clean', 'known', 'unseen']) AS s) WHERE label <> 'NEEDS_REVIEW'", "labelled")
def adversarial_slices(spark, d):
    rows = L.trainable(view(spark, d, "labelled")).withColumn("slice", F.explode(F.array(*(F.lit(s) for s in ("clean", "known", "unseen")))))
    text = F.when(F.col("slice") == "clean", F.col("text")).when(F.col("slice") == "known", F.replace("text", F.lit(" "), F.lit("​ "))).otherwise(F.translate("text", "aeo微信", "@30薇伈"))
    return rows.select(F.concat_ws("-", "id", "slice").alias("id"), F.col("id").alias("parent_id"), "slice", text.alias("text"))


@query("contact_allowlist", "SELECT msg_id, EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = m.sender::BIGINT AND c.c_nationkey < 5) AS allowed FROM messages m", "messages")
def contact_allowlist(spark, d):
    contacts = view(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("sender")).distinct().withColumn("_known", F.lit(True))
    return view(spark, d, "messages").join(contacts, "sender", "left").select("msg_id", F.col("_known").isNotNull().alias("allowed"))


@query("temporal_allowlist", "SELECT DISTINCT m.event_id FROM events m JOIN events a ON a.user_id = m.user_id AND a.event_type = 'click' AND a.ts BETWEEN m.ts - INTERVAL 30 MINUTE AND m.ts AND a.event_id <> m.event_id WHERE m.event_type = 'purchase'")
def temporal_allowlist(spark, d):
    """Purchases that follow a click of the same user within 30 minutes."""
    return allowed_by_act(*purchases_and_clicks(spark, d)).filter("allowed").select(F.col("message_id").alias("event_id"))


def purchases_and_clicks(spark, d):
    events = view(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return events.filter("event_type = 'purchase'").withColumnRenamed("event_id", "message_id"), events.filter("event_type = 'click'")


@query("random_sample_order", "SELECT id FROM labelled ORDER BY md5('9:' || id) LIMIT 64", "labelled")
def random_sample_order(spark, d):
    return view(spark, d, "labelled").orderBy(S.order_digest(9, F.col("id"))).limit(64).select("id")
