"""Rule matching and routing of messages: narrow column expressions, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import encode_bytes, normalize_text
from textloom.schema import LABELS


@dataclass(frozen=True)
class Rule:
    id: str
    language: str
    type: str
    priority: int
    pattern: str
    category: str
    action: str
    reason: str


# The rule table, in file order.
RULES = (
    Rule("OTP_CN_001", "zh", "OTP_PROTECT", 100, r"(?:验证码|动态密码|校验码|短信密码)\s*[:：是为]?\s*([0-9]{4,8})", "TRANSACTION", "INBOX", "OTP_WITH_NEARBY_CODE"),
    Rule("OTP_EN_001", "en", "OTP_PROTECT", 100, r"(?:verification\s+code|passcode|one[- ]time\s+password|OTP|code)\s*[:#]?\s*([0-9]{4,8})", "TRANSACTION", "INBOX", "OTP_WITH_NEARBY_CODE"),
    Rule("OTP_HI_001", "hi", "OTP_PROTECT", 100, r"(?:OTP|ओटीपी|कोड|सत्यापन\s*कोड)\s*[:：]?\s*([0-9]{4,8})", "TRANSACTION", "INBOX", "OTP_WITH_NEARBY_CODE"),
    Rule("OTP_ID_001", "id", "OTP_PROTECT", 100, r"(?:OTP|kode\s+verifikasi|kode\s+rahasia|kode)\s*[:：]?\s*([0-9]{4,8})", "TRANSACTION", "INBOX", "OTP_WITH_NEARBY_CODE"),
    Rule("TXN_CN_001", "zh", "TRANSACTION_HINT", 80, r"(?:入账|扣款|航班|订单|余额变动|信用卡消费)", "TRANSACTION", "INBOX", "TRANSACTION_HINT"),
    Rule("TXN_CN_002", "zh", "TRANSACTION_HINT", 75, r"(?:银行|储蓄卡|借记卡).{0,20}(?:入账|到账|转入)", "TRANSACTION", "INBOX", "BANK_CREDIT_HINT"),
    Rule("PICKUP_CN_001", "zh", "PICKUP_PROTECT", 95, r"(?:取件码|提货码|快递柜|自提码)\s*[:：]?\s*([A-Za-z0-9]{4,10})", "TRANSACTION", "INBOX", "PICKUP_WITH_NEARBY_CODE"),
    Rule("PICKUP_EN_001", "en", "PICKUP_PROTECT", 95, r"(?:pickup\s+code|parcel\s+locker|collection\s+code)\s*[:#]?\s*([A-Za-z0-9]{4,10})", "TRANSACTION", "INBOX", "PICKUP_WITH_NEARBY_CODE"),
    Rule("TXN_EN_001", "en", "TRANSACTION_HINT", 70, r"(?:credited|debited|payment\s+received|flight\s+booking|order\s+confirmed)", "TRANSACTION", "INBOX", "TRANSACTION_HINT"),
    Rule("FRAUD_CN_001", "zh", "FRAUD_RISK", 90, r"(?:安全账户.{0,30}转账|转账.{0,30}安全账户)", "FRAUD", "REVIEW", "HIGH_FRAUD_RISK"),
    Rule("FRAUD_CN_002", "zh", "FRAUD_RISK", 92, r"(?:公检法|公安局|检察院|法院).{0,40}(?:冻结|调查|涉嫌)", "FRAUD", "REVIEW", "HIGH_FRAUD_RISK"),
    Rule("FRAUD_CN_003", "zh", "FRAUD_RISK", 88, r"(?:验证码|动态密码).{0,20}(?:发送|提供|告知).{0,20}(?:工作人员|客服)", "FRAUD", "REVIEW", "HIGH_FRAUD_RISK"),
    Rule("FRAUD_CN_004", "zh", "FRAUD_RISK", 85, r"(?:冒充|假冒).{0,20}(?:银行|公安|快递|领导)", "FRAUD", "REVIEW", "HIGH_FRAUD_RISK"),
    Rule("FRAUD_EN_001", "en", "FRAUD_RISK", 85, r"(?:secure\s+account|verify\s+immediately|suspended\s+account).{0,40}(?:click|link|http)", "FRAUD", "REVIEW", "PHISHING_RISK"),
    Rule("FRAUD_EN_002", "en", "FRAUD_RISK", 80, r"(?:bit\.ly|tinyurl|goo\.gl|t\.co)/[A-Za-z0-9]+", "FRAUD", "REVIEW", "SUSPICIOUS_URL"),
    Rule("AD_CN_001", "zh", "AD_HINT", 60, r"(?:退订|回复TD|回复T退订|优惠券|限时促销|点击领取)", "AD", "SUSPECT", "AD_HINT"),
    Rule("AD_EN_001", "en", "AD_HINT", 60, r"(?:unsubscribe|reply\s+STOP|special\s+offer|limited\s+time\s+deal)", "AD", "SUSPECT", "AD_HINT"),
    Rule("HARASS_CN_001", "zh", "HARASS_HINT", 70, r"(?:还钱|催债|别装看不见|天天给你打电话|拉黑我就|去你公司找你)", "HARASS", "SUSPECT", "HARASS_DEBT_PRESSURE"),
    Rule("HARASS_EN_001", "en", "HARASS_HINT", 70, r"(?:pay\s+me\s+back|keep\s+calling|know\s+where\s+you\s+work|contact\s+your\s+manager|stop\s+ignoring\s+me)", "HARASS", "SUSPECT", "HARASS_PRESSURE"),
    Rule("HARASS_HI_001", "hi", "HARASS_HINT", 70, r"(?:पैसा\s*वापस|परेशान|बार-बार\s*कॉल)", "HARASS", "SUSPECT", "HARASS_PRESSURE"),
    Rule("HARASS_ID_001", "id", "HARASS_HINT", 70, r"(?:bayar\s+utang|terus\s+menghubungi|jangan\s+abaikan|tahu\s+alamat)", "HARASS", "SUSPECT", "HARASS_PRESSURE"),
)

THRESHOLDS = {"TRANSACTION": 0.55, "AD": 0.70, "HARASS": 0.70, "FRAUD": 0.75}


def rules_by_priority(rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Highest priority first; ties keep file order."""
    return sorted(rules, key=lambda r: -r.priority)


def match_rules(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Ids of all rules found in a text, highest priority first. Patterns are literals, so each compiles once a task.

    Of an ASCII text an expression sees only what is left of it in lower case, so it runs on those alone that hold one of the
    literals that it needs; on any other text every expression runs.
    """
    from textloom.operators.rule_table import needed_literals

    ordered, low, wide = rules_by_priority(rules), F.lower(text), F.octet_length(text) != F.length(text)
    found = []
    for r, literals in zip(ordered, needed_literals([r.pattern for r in ordered]), strict=True):
        hit = text.rlike(f"(?iu){r.pattern}")
        if literals:
            hit = reduce(or_, [*(F.contains(low, F.lit(x)) for x in sorted(literals) if x.isascii()), wide]) & hit
        found.append(F.when(hit, r.id))
    return F.array_compact(F.array(*found))


def rule_signals(rule_ids: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(has_otp, has_fraud, has_pickup, category_hint, reason) of the matched ids."""

    def has(kind: str) -> Column:
        return F.arrays_overlap(rule_ids, F.array(*(F.lit(r.id) for r in rules if r.type == kind)))

    otp, fraud, pickup = has("OTP_PROTECT"), has("FRAUD_RISK"), has("PICKUP_PROTECT")
    winner = F.get(rule_ids, F.lit(0))
    category = F.create_map(*(x for r in rules for x in (F.lit(r.id), F.lit(r.category))))
    reason = F.create_map(*(x for r in rules for x in (F.lit(r.id), F.lit(r.reason))))
    said = F.when(otp & fraud, "OTP_FRAUD_CONFLICT").when(winner.isNotNull(), reason[winner]).otherwise("NO_RULE_MATCH")
    return F.struct(otp.alias("has_otp"), fraud.alias("has_fraud"), pickup.alias("has_pickup"), category[winner].alias("category_hint"), said.alias("reason"))


def softmax_probs(scores: Column) -> Column:
    """Scores that already are probabilities stay; others pass a stable softmax; a total of zero gives equal shares."""
    n = F.size(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    kept = total.between(0.95, 1.05) & F.forall(scores, lambda x: x >= 0)
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    mass = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.when(kept, scores).otherwise(F.transform(powers, lambda p: F.when(mass > 0, p / mass).otherwise(1 / n)))


def argmax_label(probs: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """Label of the first maximum; TRANSACTION where the labels end."""
    at = F.array_position(probs, F.array_max(probs)).cast("int")
    return F.coalesce(F.get(F.array(*(F.lit(x) for x in labels)), at - 1), F.lit("TRANSACTION"))


def threshold_of(category: Column, thresholds: dict[str, float] = THRESHOLDS) -> Column:
    return F.coalesce(F.create_map(*(x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))))[category], F.lit(0.5))


def route(signals: Column, probs: Column, thresholds: dict[str, float] = THRESHOLDS, no_signal_action: str = "REVIEW") -> Column:
    """struct(category, action, confidence, raw_category, reason) from rule signals and model probabilities (may be null).

    An OTP with a fraud signal is FRAUD for review; an OTP alone goes to the inbox. A model's class beats rule hints. Without
    model and signal the class is AD and the action ``no_signal_action``.
    """
    otp, fraud, pickup, hint = (signals[c] for c in ("has_otp", "has_fraud", "has_pickup", "category_hint"))
    conflict, model = otp & fraud, F.coalesce(F.size(probs) > 0, F.lit(False))
    best = argmax_label(probs)
    raw = F.when(model, best).otherwise(F.coalesce(hint, F.lit("AD")))
    category = F.when(conflict, "FRAUD").otherwise(raw)
    top = F.when(model, F.array_max(probs).cast("double")).otherwise(F.lit(0.0))
    unsure = model & (top < threshold_of(category, thresholds))
    silent = ~model & hint.isNull() & ~otp & ~pickup & ~fraud
    by_rule = (
        F.when(silent, no_signal_action).when(fraud, "SUSPECT").when(pickup, "INBOX").when(category == "TRANSACTION", F.when(hint == "TRANSACTION", "INBOX").otherwise("REVIEW")).otherwise("SUSPECT")
    )
    by_model = F.when(unsure, "REVIEW").when(category == "TRANSACTION", "INBOX").otherwise("SUSPECT")
    action = F.when(conflict, "REVIEW").when(otp, "INBOX").when(model, by_model).otherwise(by_rule)
    reason = (
        F.when(conflict, "OTP_FRAUD_CONFLICT").when(silent, "NO_MODEL_LOW_CONFIDENCE").when(unsure, "MODEL_LOW_CONFIDENCE")
        .when(signals["reason"] != "NO_RULE_MATCH", signals["reason"]).when(model, "MODEL_PREDICTION").otherwise("NO_MODEL_LOW_CONFIDENCE")
    )
    confidence = F.when(model, top).when(hint.isNotNull() | otp | pickup, F.lit(0.5)).otherwise(F.lit(0.0))
    return F.struct(category.alias("category"), action.alias("action"), confidence.alias("confidence"), raw.alias("raw_category"), reason.alias("reason"))


def classify_messages(messages: DataFrame, body: str = "body", probs: str | None = None, rules: tuple[Rule, ...] = RULES, compatibility: bool = True, no_signal_action: str = "REVIEW") -> DataFrame:
    """``messages`` with normalized, rule_ids, category, action, confidence, raw_category and reason. One narrow stage.

    ``probs`` names a column of model scores in label order; null or empty scores leave the decision to the rules.
    """
    scores = F.when(F.size(F.col(probs)) > 0, softmax_probs(F.col(probs))) if probs else F.lit(None).cast("array<double>")
    out = messages.withColumn("normalized", normalize_text(F.col(body), confusables=True, compatibility=compatibility))
    out = out.withColumn("rule_ids", match_rules(F.col("normalized"), rules))
    out = out.withColumn("_signals", rule_signals(F.col("rule_ids"), rules)).withColumn("_probs", scores)
    return out.withColumn("_route", route(F.col("_signals"), F.col("_probs"), no_signal_action=no_signal_action)).select(*messages.columns, "normalized", "rule_ids", "_route.*")


def model_inputs(messages: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(ids, label_index) of trainable rows: what a model is trained on."""
    at = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col(label)).cast("int") - 1
    return messages.filter(F.col(label).isin(*LABELS)).select(encode_bytes(normalize_text(F.col(text))).alias("ids"), at.alias("label_index"))


def score_fallback(messages: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every message with its result; one without a result goes to review as UNKNOWN, never lost."""
    ok = F.col("_found")
    joined = messages.join(results.withColumn("_found", F.lit(True)), key, "left")
    return joined.select(
        *messages.columns,
        F.when(ok, F.col("category")).otherwise("UNKNOWN").alias("category"), F.when(ok, F.col("action")).otherwise("REVIEW").alias("action"),
        F.when(ok, F.col("confidence")).otherwise(0.0).alias("confidence"), F.when(ok, F.col("reason")).otherwise("TIMEOUT_OR_ERROR").alias("reason"),
    )
