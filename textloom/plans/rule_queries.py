"""Queries over the rules of all four languages: texts that each rule was made for, with the rules that must be found typed out."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import classify as C
from textloom.operators.rule_table import join_rule_table
from textloom.places import shared_folder
from textloom.plans.message_queries import MATCHES
from textloom.plans.views import VIEWS, query, view
from textloom.sources import readers

#: Text and the rules in it, highest priority first.
SPOKEN = (
    ("您的验证码是123456", "OTP_CN_001"), ("आपका ओटीपी 445566", "OTP_HI_001"), ("kode verifikasi 4455", "OTP_ID_001"), ("OTP 7788", "OTP_EN_001,OTP_HI_001,OTP_ID_001"), ("您的订单已到", "TXN_CN_001"), ("工商银行储蓄卡转入", "TXN_CN_002"), ("取件码 A1234", "PICKUP_CN_001"),
    ("请转账到安全账户", "FRAUD_CN_001"), ("法院通知您涉嫌违法", "FRAUD_CN_002"), ("把验证码告知客服", "FRAUD_CN_003"), ("有人冒充领导", "FRAUD_CN_004"), ("回复TD退订", "AD_CN_001"), ("别装看不见快还钱", "HARASS_CN_001"), ("पैसा वापस करो", "HARASS_HI_001"),
    ("jangan abaikan, bayar utang", "HARASS_ID_001"), ("see tinyurl/abc1", "FRAUD_EN_002"), ("secure account: click", "FRAUD_EN_001"), ("parcel locker B4455", "PICKUP_EN_001"), ("account debited", "TXN_EN_001"), ("unsubscribe here", "AD_EN_001"), ("I know where you work", "HARASS_EN_001"),
    ("入账提醒 银行卡入账", "TXN_CN_001,TXN_CN_002"), ("hello", ""), ("验证码 9911 提供给工作人员", "OTP_CN_001,FRAUD_CN_003"),
)
AT = f"CAST(1 + o_orderkey % {len(SPOKEN)} AS INT)"
VIEWS["spoken"] = (("orders",), "SELECT o_orderkey AS msg_id, split_part('" + "~".join(t for t, _ in SPOKEN) + f"', '~', {AT}) AS body, split_part('" + "~".join(r for _, r in SPOKEN) + f"', '~', {AT}) AS wanted FROM orders")


def found(spark, d):
    return view(spark, d, "spoken").select("msg_id", C.match_rules(T.normalize_text(F.col("body"))).alias("ids"))


@query("match_rules_languages", "SELECT msg_id, wanted AS rule_ids FROM spoken", "spoken")
def match_rules_languages(spark, d):
    return found(spark, d).select("msg_id", F.array_join("ids", ",").alias("rule_ids"))


@query("rule_hit_stats_languages", "SELECT rule_id, count(*) AS n FROM (SELECT unnest(string_split(wanted, ',')) AS rule_id FROM spoken) WHERE rule_id <> '' GROUP BY rule_id", "spoken")
def rule_hit_stats_languages(spark, d):
    return found(spark, d).select(F.explode("ids").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("route_languages", """
SELECT msg_id, CASE WHEN wanted = 'OTP_CN_001,FRAUD_CN_003' OR wanted LIKE 'FRAUD%' THEN 'FRAUD' WHEN wanted LIKE 'HARASS%' THEN 'HARASS' WHEN wanted LIKE 'AD%' OR wanted = '' THEN 'AD' ELSE 'TRANSACTION' END AS category,
  CASE WHEN wanted = 'OTP_CN_001,FRAUD_CN_003' OR wanted = '' THEN 'REVIEW' WHEN wanted LIKE 'FRAUD%' OR wanted LIKE 'HARASS%' OR wanted LIKE 'AD%' THEN 'SUSPECT' ELSE 'INBOX' END AS action FROM spoken""", "spoken")
def route_languages(spark, d):
    return C.classify_messages(view(spark, d, "spoken")).select("msg_id", "category", "action")


def rule_file(spark, d) -> str:
    """A folder of rule files: the fixed rules, and for each part one that finds orders of its number; every seventh is disabled."""
    fixed = spark.createDataFrame([(r.id, r.language, r.type, r.priority, r.pattern, r.category, r.action, r.reason, True) for r in C.RULES], "id string, language string, type string, priority int, pattern string, categoryHint string, action string, reasonCode string, enabled boolean")
    part = F.col("p_partkey").cast("string")
    parts = view(spark, d, "part").select(F.concat(F.lit("PART_"), part).alias("id"), F.lit("en").alias("language"), F.lit("TRANSACTION_HINT").alias("type"), F.lit(1).alias("priority"), F.concat(F.lit(r"order\s+"), part, F.lit(r"\b")).alias("pattern"), F.lit("TRANSACTION").alias("categoryHint"), F.lit("INBOX").alias("action"), F.lit(None).cast("string").alias("reasonCode"), F.when(F.col("p_partkey") % 7 == 0, False).alias("enabled"), "p_partkey")
    folder = shared_folder(spark, "rules")
    fields = F.struct(*fixed.columns)
    for rows, at in ((fixed.coalesce(1), F.lit("fixed")), (parts, F.floor(F.col("p_partkey") / 10_000))):  # 10,000 rules a file at most
        rows.groupBy(at).agg(F.collect_list(fields).alias("rules")).select(F.lit("2.0.0").alias("version"), "rules").write.mode("append").option("maxRecordsPerFile", 1).json(folder)
    return folder


@query("read_rules", rf"""
SELECT 'PART_' || p_partkey AS id, 'order\s+' || p_partkey || '\b' AS pattern, 1 AS priority, 'RULE_MATCH' AS reason FROM part WHERE p_partkey % 7 <> 0
UNION ALL VALUES {', '.join(f"('{r.id}', '{r.pattern}', {r.priority}, '{r.reason}')" for r in C.RULES)}""")
def read_rules(spark, d):
    return readers.read_rules(spark, rule_file(spark, d)).select("id", "pattern", "priority", F.col("reasonCode").alias("reason"))


@query("match_rule_table", rf"""
SELECT msg_id, array_to_string(list_concat({MATCHES}, CASE WHEN k IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) THEN ['PART_' || k] ELSE [] END), ',') AS rule_ids
FROM (SELECT *, nullif(regexp_extract(body, '(?i)order\s+([0-9]+)', 1), '')::BIGINT AS k FROM messages)""", "messages")
def match_rule_table_(spark, d):
    """All rules of the files over all messages; texts are normalized first. Of equal priority the fixed rules' order holds."""
    rules, order = readers.read_rules(spark, rule_file(spark, d)), F.array(*(F.lit(r.id) for r in C.RULES))
    place = F.array_position(order, F.col("id"))
    rules = rules.withColumn("seq", F.when(place > 0, place).otherwise(len(C.RULES) + 1))
    rows = view(spark, d, "messages").select("msg_id", T.normalize_text(F.col("body")).alias("text"))
    return join_rule_table(rows, rules, "text", "msg_id").select("msg_id", F.array_join("rule_ids", ",").alias("rule_ids"))
