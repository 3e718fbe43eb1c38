"""Queries over splits, leakage, samples, corrections and joins by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import labels as L
from textloom.operators import splits as S
from textloom.plans.views import pieces, query, view
from textloom.schema import LABELS

IN_LABELS = "('TRANSACTION', 'AD', 'HARASS', 'FRAUD')"


@query("group_key", "SELECT id, template_group || '::' || sender_group AS group_key FROM labelled", "labelled")
def group_key(spark, d):
    return view(spark, d, "labelled").select("id", S.group_key("template_group", "sender_group").alias("group_key"))


def split_sql(seed: int, a: float, b: float) -> str:
    return f"""
WITH g AS (SELECT DISTINCT template_group || '::' || sender_group AS g FROM labelled),
r AS (SELECT g, row_number() OVER (ORDER BY md5('{seed}:' || g)) - 1 AS r, count(*) OVER () AS n FROM g)
SELECT id, CASE WHEN r < floor(n * {a}) THEN 'train' WHEN r < floor(n * {a}) + floor(n * {b}) THEN 'validation' ELSE 'test' END AS split
FROM labelled JOIN r ON r.g = template_group || '::' || sender_group"""


@query("split_groups", split_sql(42, 0.8, 0.1), "labelled")
def split_groups(spark, d):
    return S.split_groups(view(spark, d, "labelled"), S.group_key("template_group", "sender_group")).select("id", "split")


@query("eval_only_split", split_sql(7, 0.0, 0.5), "labelled")
def eval_only_split(spark, d):
    return S.split_groups(view(spark, d, "labelled"), S.group_key("template_group", "sender_group"), (0.0, 0.5, 0.5), 7).select("id", "split")


@query("split_groups_hash", """
SELECT id, CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT id, ('0x' || substr(md5('42:' || template_group || '::' || sender_group), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM labelled)""", "labelled")
def split_groups_hash(spark, d):
    return S.split_groups(view(spark, d, "labelled"), S.group_key("template_group", "sender_group"), mode="hash").select("id", "split")



@query("leakage_ids", "SELECT DISTINCT 'id' AS kind, a.split AS left_split, b.split AS right_split, a.id AS value FROM splits a JOIN splits b ON a.id = b.id AND a.split < b.split", "splits")
def leakage_ids(spark, d):
    return S.shared_between_splits(view(spark, d, "splits"), F.col("id"), "id")


GROUPS = "(SELECT DISTINCT split, template_group || '::' || sender_group AS g FROM splits)"


@query("leakage_groups", f"SELECT 'group' AS kind, a.split AS left_split, b.split AS right_split, a.g AS value FROM {GROUPS} a JOIN {GROUPS} b ON a.g = b.g AND a.split < b.split", "splits")
def leakage_groups(spark, d):
    return S.shared_between_splits(view(spark, d, "splits"), S.group_key("template_group", "sender_group"), "group")


PARENTS = "SELECT 'parent' AS kind, p.split AS left_split, 'test' AS right_split, c.id AS value FROM splits c JOIN (SELECT id, max(split) AS split FROM splits GROUP BY id) p ON c.parent_id = p.id WHERE c.split = 'test' AND p.split <> 'test'"


@query("leakage_parents", PARENTS, "splits")
def leakage_parents(spark, d):
    return S.leaked_parents(view(spark, d, "splits"))


@query("leakage_audit", f"""
WITH c AS (SELECT 'id' AS kind, (SELECT count(*) FROM (SELECT DISTINCT a.id, a.split, b.split FROM splits a JOIN splits b ON a.id = b.id AND a.split < b.split)) AS n
UNION ALL SELECT 'group', (SELECT count(*) FROM {GROUPS} a JOIN {GROUPS} b ON a.g = b.g AND a.split < b.split)
UNION ALL SELECT 'parent', (SELECT count(*) FROM ({PARENTS}))
UNION ALL SELECT 'template_only', (SELECT count(*) FROM (SELECT DISTINCT split, template_group AS g FROM splits) a JOIN (SELECT DISTINCT split, template_group AS g FROM splits) b ON a.g = b.g AND a.split < b.split))
SELECT kind, n, CASE WHEN n = 0 THEN 'PASS' WHEN kind = 'template_only' THEN 'WARN' ELSE 'FAIL' END AS status FROM c
UNION ALL SELECT 'all', sum(n)::BIGINT, CASE WHEN sum(n) = 0 THEN 'PASS' ELSE 'FAIL' END FROM c WHERE kind <> 'template_only'""", "splits")
def leakage_audit(spark, d):
    return S.leakage_audit(view(spark, d, "splits"))


def sample_sql(per: str, total: int) -> str:
    return f"""
WITH r AS (SELECT id, label, md5('42:' || id) AS x, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) AS k FROM labelled),
p AS (SELECT id FROM r WHERE k <= {per}), f AS (SELECT id FROM r WHERE k > {per} ORDER BY x LIMIT (SELECT greatest(0, {total} - count(*)) FROM p))
SELECT id FROM p UNION ALL SELECT id FROM f"""


@query("pilot_sample_even", sample_sql("(SELECT 103 // count(DISTINCT label) FROM labelled)", 103), "labelled")
def pilot_sample_even(spark, d):
    return S.sample_even(view(spark, d, "labelled"), "label", "id", 103).select("id")


@query("pilot_sample_per_class", sample_sql("160", 820), "labelled")
def pilot_sample_per_class(spark, d):
    return S.sample_per_class(view(spark, d, "labelled"), "label", "id", 160, 820).select("id")


@query("freeze_sample", """
WITH t AS (SELECT *, md5('42:' || id) AS x, md5('42:' || source) AS g, row_number() OVER (PARTITION BY language, label, source ORDER BY md5('42:' || id)) AS turn FROM labelled)
SELECT id, language, label FROM (SELECT *, row_number() OVER (PARTITION BY language, label ORDER BY turn, g, x) AS k FROM t) WHERE k <= 25""", "labelled")
def freeze_sample(spark, d):
    return S.freeze_sample(view(spark, d, "labelled"), ("language", "label"), "source", "id", 25).select("id", "language", "label")


@query("label_gap_matrix", f"""
SELECT l.language, b.label, count(m.id) AS have, 400 AS target, greatest(0, 400 - count(m.id)) AS shortfall
FROM (SELECT unnest(['zh', 'en', 'hi', 'id']) AS language) l CROSS JOIN (SELECT unnest({list(LABELS)}) AS label) b LEFT JOIN labelled m ON m.language = l.language AND m.label = b.label GROUP BY ALL""", "labelled")
def label_gap_matrix(spark, d):
    cells = spark.createDataFrame([(x, y) for x in ("zh", "en", "hi", "id") for y in LABELS], "language string, label string")
    return S.shortfall(view(spark, d, "labelled"), cells, ("language", "label"), 400)


@query("gap_priority", f"""
SELECT * FROM (SELECT l.language, b.label, greatest(0, 400 - count(m.id)) AS shortfall
FROM (SELECT unnest(['zh', 'en', 'hi', 'id']) AS language) l CROSS JOIN (SELECT unnest({list(LABELS)}) AS label) b LEFT JOIN labelled m ON m.language = l.language AND m.label = b.label GROUP BY ALL) WHERE shortfall > 0""", "labelled")
def gap_priority(spark, d):
    return label_gap_matrix(spark, d).filter("shortfall > 0").orderBy(F.desc("shortfall"), "language", "label").select("language", "label", "shortfall")


@query("dual_pack", "SELECT id, p AS pack, '' AS label, '' AS annotator FROM labelled, (SELECT unnest(['A', 'B']) AS p) WHERE label <> 'NEEDS_REVIEW'", "labelled")
def dual_pack(spark, d):
    return S.dual_pack(L.trainable(view(spark, d, "labelled"))).select("id", "pack", "label", "annotator")


@query("dual_agreement", """
SELECT coalesce(a.id, b.id) AS id, a.label AS label_a, b.label AS label_b, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'single' WHEN a.label = b.label THEN 'gold' ELSE 'adjudicate' END AS status, CASE WHEN a.label = b.label THEN a.label END AS gold
FROM (SELECT id, label FROM packs) a FULL JOIN (SELECT id, suggested_label AS label FROM packs WHERE pack <> 'zh') b ON a.id = b.id""", "packs")
def dual_agreement(spark, d):
    rows = view(spark, d, "packs")
    return S.dual_agreement(rows, rows.filter("pack <> 'zh'").select("id", F.col("suggested_label").alias("label")))


@query("annotator_kappa", """
WITH c AS (SELECT label AS a, suggested_label AS b, count(*) AS n FROM packs GROUP BY ALL), t AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (a = b) AS same FROM c),
e AS (SELECT sum(x.n * y.n) AS p FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y ON x.a = y.b)
SELECT n, round((same / n)::DOUBLE, 9) AS observed, round((p / (n * n))::DOUBLE, 9) AS expected, round(((same / n - p / (n * n)) / (1 - p / (n * n)))::DOUBLE, 9) AS kappa FROM t, e""", "packs")
def annotator_kappa(spark, d):
    pairs = view(spark, d, "packs").select(F.col("label").alias("label_a"), F.col("suggested_label").alias("label_b"))
    return S.cohen_kappa(pairs).select("n", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


@query("random_per_class", "SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || id)) AS k FROM labelled) WHERE k <= 10", "labelled")
def random_per_class(spark, d):
    rows = view(spark, d, "labelled")
    return S.top_of_each(rows, ["label"], [S.order_digest(5, F.col("id"))], 10).select("id", "label")


@query("trainable_filter", f"SELECT id FROM labelled WHERE label IN {IN_LABELS}", "labelled")
def trainable_filter(spark, d):
    return L.trainable(view(spark, d, "labelled")).select("id")


@query("annotation_to_message", f"""
SELECT id, trim(text) AS text, upper(label) AS label, language, source, 'snd-ann-' || id AS sender_group, CASE template_group WHEN '' THEN 'tpl-' || id ELSE template_group END AS template_group, CASE annotator WHEN '' THEN 'annotator' ELSE annotator END AS annotator
FROM annotations WHERE upper(label) IN {IN_LABELS} AND text <> ''""", "annotations")
def annotation_to_message(spark, d):
    out = L.annotation_to_message(view(spark, d, "annotations"))
    return out.withColumn("annotator", F.get("annotator_ids", F.lit(0))).drop("annotator_ids")


#: Two packs that share ids: the first has every third row as advertising, the second all rows.
PACKS = "(SELECT 0 AS pack, id, 'AD' AS label, text, CAST(id AS BIGINT) AS seq FROM annotations WHERE CAST(id AS BIGINT) % 3 = 0 UNION ALL SELECT 1, id, upper(label), text, CAST(id AS BIGINT) FROM annotations)"
MERGED_PACKS = f"(SELECT id, arg_min(label, pack) AS label, min(pack) AS pack FROM {PACKS} WHERE label IN {IN_LABELS} AND trim(text) <> '' GROUP BY id)"


def two_packs(spark, d):
    rows = view(spark, d, "annotations").withColumn("seq", F.col("id").cast("long"))
    return [rows.filter("seq % 3 = 0").withColumn("label", F.lit("ad")), rows]


@query("merge_annotation_packs", f"SELECT id, label, pack FROM {MERGED_PACKS}", "annotations")
def merge_annotation_packs(spark, d):
    return L.merge_packs(two_packs(spark, d)).select("id", "label", "pack")


@query("merge_report", f"SELECT p.pack, count(*) AS n, count(*) FILTER (p.label IN {IN_LABELS} AND trim(p.text) <> '') AS trainable, count(m.id) AS kept FROM {PACKS} p LEFT JOIN {MERGED_PACKS} m ON p.id = m.id AND p.pack = m.pack GROUP BY p.pack", "annotations")
def merge_report(spark, d):
    packs = two_packs(spark, d)
    return L.merge_report(packs, L.merge_packs(packs))


@query("validate_messages", f"""
SELECT id, e AS error FROM (SELECT id, unnest([CASE WHEN text = '' THEN 'text is required' END, 'source_license is required', CASE WHEN template_group = '' THEN 'template_group is required' END,
  CASE WHEN label NOT IN {IN_LABELS} THEN 'invalid label: ' || label END, CASE WHEN split NOT IN ('train', 'validation', 'test') THEN 'invalid split: ' || split END]) AS e
FROM (SELECT a.id, a.text, a.label, a.template_group, s.split FROM annotations a JOIN splits s ON a.id = s.id)) WHERE e IS NOT NULL
UNION ALL SELECT id, 'duplicate id: ' || id FROM (SELECT id, row_number() OVER (PARTITION BY id) AS k FROM splits) WHERE k > 1""", "annotations", "splits")
def validate_messages(spark, d):
    n = pieces(spark, f"{d}/orders.parquet")  # a fixed number of rows for a task, whatever their sum
    rows, splits = view(spark, d, "annotations").repartition(n, "id"), view(spark, d, "splits").select("id", "split", "sender_group").repartition(n, "id")
    return L.validation_errors(rows.join(splits, "id").withColumn("source_license", F.lit("")))


@query("label_domain_check", "SELECT label, count(*) AS n FROM annotations WHERE label NOT IN ('TRANSACTION', 'AD', 'HARASS', 'FRAUD', 'NEEDS_REVIEW') GROUP BY label", "annotations")
def label_domain_check(spark, d):
    known = spark.createDataFrame([(x,) for x in (*LABELS, "NEEDS_REVIEW")], "label string")
    return view(spark, d, "annotations").join(F.broadcast(known), "label", "left_anti").groupBy("label").agg(F.count("*").alias("n"))


MERGED = "(SELECT id, arg_max(new, priority * 1000000000000 + seq) AS new, arg_max(reason, priority * 1000000000000 + seq) AS reason FROM corrections WHERE new <> 'SPAM' GROUP BY id)"


@query("merge_corrections", f"SELECT * FROM {MERGED}", "corrections")
def merge_corrections(spark, d):
    return L.merge_corrections(view(spark, d, "corrections")).select("id", "new", "reason")


@query("blocked_transitions", "SELECT c.id, c.seq, c.source, (c.old = 'FRAUD' AND c.new = 'AD' AND regexp_matches(l.text, 'click|bit\\.ly')) AS blocked FROM corrections c JOIN labelled l ON c.id = l.id", "corrections")
def blocked_transitions(spark, d):
    return L.blocked_transitions(view(spark, d, "corrections"), view(spark, d, "labelled"), ("click", "bit.ly")).select("id", "seq", "source", "blocked")


@query("apply_corrections", f"""
WITH j AS (SELECT a.id, a.label, a.notes, a.annotator, m.new, m.reason, coalesce(m.new <> a.label, false) AS changed FROM annotations a LEFT JOIN {MERGED} m ON a.id = m.id)
SELECT id, CASE WHEN changed THEN new ELSE label END AS label, changed, CASE WHEN changed THEN CASE notes WHEN '' THEN '' ELSE notes || ' | ' END || '[fix:' || label || '->' || new || '] ' || reason ELSE notes END AS notes,
  CASE WHEN changed AND annotator = '' THEN 'fix' ELSE annotator END AS annotator FROM j""", "annotations", "corrections")
def apply_corrections(spark, d):
    merged = L.merge_corrections(view(spark, d, "corrections"))
    return L.apply_corrections(view(spark, d, "annotations"), merged).select("id", "label", "changed", "notes", "annotator")


REPAIRS = "SELECT id, CASE length(id) % 3 WHEN 0 THEN 'FRAUD' WHEN 1 THEN 'AD' ELSE '' END AS label, 'r' || right(id, 1) AS reason FROM annotations"


def repaired_sql(before: str, tag: str, annotator: str, overwrite: str) -> str:
    return f"""SELECT a.id, CASE WHEN c THEN r.label ELSE a.label END AS label, CASE WHEN c THEN trim('[{tag}:' || r.reason || ' ' || old || '->' || r.label || '] ' || trim(a.notes)) ELSE a.notes END AS notes,
  CASE WHEN c AND {overwrite} THEN '{annotator}' ELSE a.annotator END AS annotator
FROM (SELECT *, upper(trim(label)) AS old FROM ({before})) a JOIN (SELECT b.id, b.label, b.reason FROM ({REPAIRS}) b) r ON r.id = a.id, LATERAL (SELECT r.label <> '' AND r.label <> a.old AS c)"""


@query("apply_repairs", repaired_sql(repaired_sql("SELECT id, label, notes, annotator FROM annotations", "fix", "qa_fix_v1", "trim(a.annotator) = ''").replace("'FRAUD'", "'HARASS'"), "fix_v2", "audit_fixpass_en", "true"), "annotations")
def apply_repairs(spark, d):
    """Two passes over a pack: the first fills annotators, the second overwrites them; notes pile up in front."""
    rows = view(spark, d, "annotations").select("id", "label", "notes", "annotator")
    kind = F.length("id") % 3
    decided = rows.select("id", F.when(kind == 0, "FRAUD").when(kind == 1, "AD").otherwise("").alias("label"), F.concat(F.lit("r"), F.right("id", F.lit(1))).alias("reason"))
    first = L.apply_repairs(rows, decided.replace("FRAUD", "HARASS", subset=["label"])).drop("changed")
    return L.apply_repairs(first, decided, "fix_v2", "audit_fixpass_en", overwrite=True).select("id", "label", "notes", "annotator")


@query("apply_hand_labels", "SELECT l.id, coalesce(h.new, 'NEEDS_REVIEW') AS label, coalesce(h.source, '') AS note FROM labelled l LEFT JOIN (SELECT id, new, source FROM corrections WHERE source = 'agent') h ON l.id = h.id", "labelled", "corrections")
def apply_hand_labels(spark, d):
    hand = view(spark, d, "corrections").filter("source = 'agent'").select("id", F.col("new").alias("label"), F.col("source").alias("note"))
    return L.apply_hand_labels(view(spark, d, "labelled"), hand).select("id", "label", "note")


@query("label_by_template_group", "SELECT l.id, coalesce(t.label, 'NEEDS_REVIEW') AS label FROM labelled l LEFT JOIN (SELECT template_group, max(label) AS label FROM labelled WHERE msg_id < 7 GROUP BY template_group) t ON l.template_group = t.template_group", "labelled")
def label_by_template_group(spark, d):
    rows = view(spark, d, "labelled")
    return L.label_by_template(rows, rows.filter("msg_id < 7").select("template_group", "label")).select("id", "label")


@query("template_exemplars", "SELECT template_group, min(msg_id)::VARCHAR AS exemplar_id, arg_min(text, msg_id) AS exemplar, count(*) AS n FROM labelled GROUP BY template_group", "labelled")
def template_exemplars(spark, d):
    return L.template_exemplars(view(spark, d, "labelled"), "msg_id")


@query("prediction_join", "SELECT l.id, l.label, coalesce(p.predicted, 'AD') AS predicted, p.predicted IS NULL AS filled FROM labelled l LEFT JOIN predictions p ON l.id = p.id", "labelled", "predictions")
def prediction_join(spark, d):
    return L.prediction_join(view(spark, d, "labelled"), view(spark, d, "predictions")).select("id", "label", "predicted", "filled")


@query("soft_label_join", """
WITH x AS (SELECT l.id, CASE WHEN cust % 13 = 0 THEN [0.0, 0.0, 0.0, 0.0] ELSE [(cust % 7)::DOUBLE, (cust % 5)::DOUBLE, (cust % 3)::DOUBLE, 1.0] END AS z FROM labelled l),
e AS (SELECT id, list_transform(z, lambda v: exp((v - list_max(z)) / 2)) AS e FROM x)
SELECT id, round(e[1] / list_sum(e), 9) AS p0, round(e[2] / list_sum(e), 9) AS p1, round(e[3] / list_sum(e), 9) AS p2, round(e[4] / list_sum(e), 9) AS p3 FROM e""", "labelled")
def soft_label_join(spark, d):
    rows = view(spark, d, "labelled")
    logits = rows.filter("cust % 13 <> 0").select("id", F.array(*(F.col("cust").cast("double") % k for k in (7, 5, 3)), F.lit(1.0)).alias("logits"))
    soft = L.soft_labels(rows.select("id"), logits)
    return soft.select("id", *(F.round(F.get("soft", F.lit(k)), 9).alias(f"p{k}") for k in range(4)))


@query("source_audit", """
SELECT count(*) AS n_sources, count(*) FILTER (n_nationkey % 3 = 0) AS n_synthetic, count(*) FILTER (n_nationkey % 2 = 0) AS n_approved, count(*) FILTER (n_nationkey % 9 = 0) AS missing_license,
  array_to_string(list_sort(list(DISTINCT CASE WHEN n_nationkey % 9 <> 0 THEN 'license-' || n_regionkey END)), ',') AS licenses, 'WARN' AS status FROM nation""")
def source_audit(spark, d):
    key = F.col("n_nationkey")
    sources = view(spark, d, "nation").select(F.col("n_name").alias("id"), F.when(key % 9 != 0, F.concat(F.lit("license-"), F.col("n_regionkey").cast("string"))).alias("license"), (key % 3 == 0).alias("is_synthetic"), (key % 2 == 0).alias("approved_for_git"))
    return L.source_audit(sources).withColumn("licenses", F.array_join("licenses", ","))
