"""Queries over candidates for another look."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import candidates as C
from textloom.operators.descent import predict_descent, sparse_rows, train_descent
from textloom.plans.message_queries import vocabulary
from textloom.plans.text_queries import probe_rows, probes
from textloom.plans.views import query, view
from textloom.schema import LABELS

HINTS = (("debt", "loan", "hutang", "casino", "poker", "hadiah", "otp", "diskon", "催收", "plain", "sale", "saldo", "collection agency", "menang", "togel", "nothing"),)
PRIOR = "CASE msg_id % 3 WHEN 0 THEN 'NEEDS_REVIEW' WHEN 1 THEN 'AD' ELSE 'FRAUD' END"
LANGUAGE = "CASE msg_id % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'en' WHEN 2 THEN 'hi' ELSE 'xx' END"
ROWS = f"(SELECT msg_id::VARCHAR AS id, t AS text, {LANGUAGE} AS language, {PRIOR} AS prior_label FROM {probes(HINTS)} WHERE t IS NOT NULL)"


def rows(spark, d):
    return probe_rows(spark, d, HINTS).select(F.col("msg_id").cast("string").alias("id"), F.col("t").alias("text"), F.expr(LANGUAGE).alias("language"), F.expr(PRIOR).alias("prior_label"))


@query("relabel_candidates", f"""
WITH s AS (SELECT *, {' + '.join(f"regexp_matches(text, '{p}', 'i')::INT" for p in C.HARASS_HINTS)} AS h FROM {ROWS}),
r AS (SELECT id, CASE WHEN prior_label = 'NEEDS_REVIEW' AND h > 0 THEN 'nr_hint' WHEN prior_label = 'AD' AND h > 0 THEN 'ad_borderline' WHEN prior_label = 'NEEDS_REVIEW' AND language <> 'xx' THEN 'nr_pool' END AS suggest_reason,
  CASE WHEN prior_label = 'NEEDS_REVIEW' AND h > 0 THEN h + 10 WHEN prior_label = 'AD' THEN h ELSE 0 END AS score FROM s)
SELECT id, suggest_reason, score FROM r WHERE suggest_reason IS NOT NULL ORDER BY score DESC, md5('42:' || id) LIMIT 300""", "messages")
def relabel_candidates(spark, d):
    return C.relabel_candidates(rows(spark, d), 300).select("id", "suggest_reason", "score")


@query("gap_fill_candidates", f"""
WITH s AS (SELECT id, CASE WHEN regexp_matches(text, '{C.ID_FRAUD_HINT}', 'i') THEN 'FRAUD' WHEN regexp_matches(text, '{C.ID_TXN_HINT}', 'i') THEN 'TRANSACTION' WHEN regexp_matches(text, '{C.ID_HARASS_HINT}', 'i') THEN 'HARASS' WHEN regexp_matches(text, '{C.ID_AD_HINT}', 'i') THEN 'AD' ELSE 'NEEDS_REVIEW' END AS suggested_label
  FROM {ROWS} WHERE language = 'id' AND prior_label = 'NEEDS_REVIEW')
SELECT id, suggested_label FROM s ORDER BY list_position({list(C.GAP_ORDER)}, suggested_label), id LIMIT 70""", "messages")
def gap_fill_candidates(spark, d):
    return C.gap_fill_candidates(rows(spark, d), 70).select("id", "suggested_label")


@query("pilot_sample_quota", """
WITH h AS (SELECT count(*) FILTER (label = 'NEEDS_REVIEW') AS nr, count(*) FILTER (label = 'TRANSACTION') AS tx, count(*) FILTER (label = 'FRAUD') AS fr, count(*) FILTER (label = 'AD') AS ad, count(*) FILTER (label = 'HARASS') AS ha FROM labelled),
a AS (SELECT *, least(nr, 240) AS q_nr, least(tx, 800 - least(nr, 240)) AS q_tx FROM h), b AS (SELECT *, 800 - q_nr - q_tx AS rest FROM a),
c AS (SELECT *, least(fr, greatest(80, rest // 3)) AS f0, least(ad, greatest(80, rest // 3)) AS a0 FROM b), e AS (SELECT *, greatest(0, f0 + a0 - rest) AS over FROM c),
g AS (SELECT *, a0 - least(a0, over) AS q_ad, greatest(0, f0 - (over - least(a0, over))) AS q_fr FROM e), q AS (SELECT *, least(ha, greatest(0, rest - q_fr - q_ad)) AS q_ha FROM g),
r AS (SELECT id, label, md5('42:' || id) AS x, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) AS k FROM labelled),
p AS (SELECT r.*, k <= CASE label WHEN 'NEEDS_REVIEW' THEN q_nr WHEN 'TRANSACTION' THEN q_tx WHEN 'FRAUD' THEN q_fr WHEN 'AD' THEN q_ad ELSE q_ha END AS picked FROM r, q)
SELECT id FROM p WHERE picked UNION ALL SELECT id FROM (SELECT id FROM p WHERE NOT picked ORDER BY x LIMIT (SELECT greatest(0, 800 - count(*)) FROM p WHERE picked))""", "labelled")
def pilot_sample_quota(spark, d):
    return C.sample_quota(view(spark, d, "labelled"), "label", "id", 800).select("id")


@query("representative_sample", r"""
WITH h AS (SELECT msg_id, hex(encode(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))) AS h FROM labelled ORDER BY msg_id LIMIT 100)
SELECT msg_id, md5(array_to_string(list_transform(range(0, 512), lambda i: CASE WHEN 2 * i < length(h) THEN ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::INT + 1 ELSE 0 END), ',')) AS ids FROM h""", "labelled")
def representative_sample(spark, d):
    out = C.representative_sample(view(spark, d, "labelled"), "msg_id", 100)
    return out.select("msg_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query("train_ngram_logistic", None)
def train_ngram_logistic(spark, d):
    """Share of right labels among the rows that the model was not trained on: 4,096 n-grams, 100 iterations."""
    labelled = view(spark, d, "labelled").filter("label <> 'NEEDS_REVIEW'").select("id", "msg_id", "text", "label")
    words = vocabulary(labelled).persist()  # 4,096 rows, read twice
    model, _ = C.train_ngram_logistic(labelled.filter("msg_id % 4 <> 1"), words)
    held = C.ngram_table(labelled.filter("msg_id % 4 = 1"), words)
    scored = model.setPredictionCol("predicted").transform(held)
    return scored.agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("label_index")).cast("double")), 6).alias("accuracy"))


@query("train_ngram_descent", "SELECT id, label AS predicted FROM labelled WHERE label <> 'NEEDS_REVIEW' AND msg_id % 4 = 1", "labelled")
def train_ngram_descent(spark, d):
    """What the model of 200 rounds says of the rows it wasn't trained on: it finds the label that their template has.

    Rows of equal text and label are one row that counts as often; in the order of their texts, rows that are alike lie together.
    """
    labelled = view(spark, d, "labelled").filter("label <> 'NEEDS_REVIEW'").select("id", "msg_id", "text", "label")
    words = vocabulary(labelled).persist()  # 4,096 rows, read three times
    size = words.count()
    different = labelled.filter("msg_id % 4 <> 1").groupBy("text", "label").agg(F.count("*").alias("times")).sortWithinPartitions("label", "text")
    weights = train_descent(sparse_rows(C.ngram_table(different, words), times="times"), size, len(LABELS))
    found = predict_descent(C.ngram_table(labelled.filter("msg_id % 4 = 1"), words), weights, "id")
    return found.select("id", F.get(F.array(*(F.lit(x) for x in LABELS)), F.col("class_index")).alias("predicted"))
