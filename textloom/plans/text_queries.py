"""Queries over texts: normalization, encoding, templates, deduplication, weak labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dedupe, weak_labels as W
from textloom.plans.views import query, view

NORMAL = r"left(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'), ' '), 4096)"


@query("normalize_text", f"SELECT msg_id, {NORMAL.format('body')} AS normalized FROM messages", "messages")
def normalize_text(spark, d):
    return view(spark, d, "messages").select("msg_id", T.normalize_text(F.col("body")).alias("normalized"))


@query("map_confusables", f"SELECT doc_id, md5(translate(replace(replace(text, '薇信', '微信'), 'v信', '微信'), '{T.CONFUSABLE_FROM}', '{T.CONFUSABLE_TO}')) AS mapped FROM documents")
def map_confusables(spark, d):
    return view(spark, d, "documents").select("doc_id", F.md5(T.map_confusables(F.col("text"))).alias("mapped"))


@query("encode_bytes", """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, CASE WHEN length(h) > 1024 THEN left(h, 768) || right(h, 256) ELSE h END AS h FROM h)
SELECT doc_id, array_to_string(list_transform(range(0, 512), lambda i: CASE WHEN 2 * i < length(h) THEN ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::INT + 1 ELSE 0 END), ',') AS ids FROM c""")
def encode_bytes(spark, d):
    return view(spark, d, "documents").select("doc_id", F.array_join(T.encode_bytes(F.col("text")).cast("array<string>"), ",").alias("ids"))


@query("byte_ngrams", """
WITH h AS (SELECT msg_id, lower(hex(encode(body))) AS h FROM messages)
SELECT msg_id, len(g) AS n_grams, md5(array_to_string(g, ',')) AS grams FROM (SELECT msg_id,
  list_concat(list_transform(range(0, length(h) // 2 - 1), lambda i: substr(h, (2 * i + 1)::BIGINT, 4)), list_transform(range(0, length(h) // 2 - 2), lambda i: substr(h, (2 * i + 1)::BIGINT, 6))) AS g FROM h)""", "messages")
def byte_ngrams(spark, d):
    grams = T.byte_ngrams(F.col("body"))
    return view(spark, d, "messages").select("msg_id", F.size(grams).cast("long").alias("n_grams"), F.md5(F.array_join(grams, ",")).alias("grams"))


@query("template_group", r"""
SELECT msg_id,
  left(sha1(array_to_string(string_split(trim(regexp_replace(regexp_replace(lower(body), '\d+', '#', 'g'), '[^a-z#]+', ' ', 'g'), ' '), ' ')[1:10], ' ')), 12) AS words,
  left(sha1(left(regexp_replace(regexp_replace(body, '\d+', '#', 'g'), '\s+', '', 'g'), 40)), 12) AS compact,
  left(sha1(left(trim(regexp_replace(regexp_replace(regexp_replace(lower(body), 'https?://\S+|www\.\S+', '<url>', 'g'), '\b\d+\b', '#', 'g'), '\s+', ' ', 'g'), ' '), 160)), 12) AS links,
  left(sha1(trim(regexp_replace(regexp_replace(lower(body), '\d', '0', 'g'), '\s+', ' ', 'g'), ' ')), 12) AS zeros
FROM messages""", "messages")
def template_group(spark, d):
    key = F.col("msg_id").cast("string")
    return view(spark, d, "messages").select("msg_id", *(T.template_group(F.col("body"), s, key).alias(s) for s in ("words", "compact", "links", "zeros")))


@query("template_fingerprint_normalized", r"SELECT msg_id, regexp_replace(translate(body, '０１２３４５６７８９', '0123456789'), '[\s/]+', '', 'g') AS fingerprint FROM messages", "messages")
def template_fingerprint(spark, d):
    return view(spark, d, "messages").select("msg_id", T.keyword_fingerprint(F.col("body")).alias("fingerprint"))


def quoted(words: Sequence[str]) -> str:
    """An RE2 alternation that finds any of ``words``, for SQL."""
    out = "|".join("".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in w) for w in words)
    return out.replace("'", "''")


LEXICON = (*W.ZH_TXN, *W.ZH_FRAUD, *W.ZH_AD, *W.ZH_HARASS)


@query("looks_like_message", rf"""
SELECT doc_id, (length(text) BETWEEN 4 AND 500 AND NOT (length(text) > 180 AND (contains(text, '。。') OR length(text) - length(replace(text, '，', '')) > 8))
  AND (length(text) <= 200)::INT + regexp_matches(text, '\d{{5,}}')::INT + 2 * regexp_matches(text, '{quoted(LEXICON)}')::INT + regexp_matches(text, '(http|www\.|t\.cn|【|】|退订|回复)', 'i')::INT >= 2) AS keep
FROM documents WHERE text IS NOT NULL""")
def looks_like_message(spark, d):
    return view(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.looks_like_message(F.col("text"), LEXICON).alias("keep"))


@query("script_profile", """
SELECT doc_id, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS has_cjk, regexp_matches(text, '[\\x{0900}-\\x{097f}]') AS has_devanagari,
  len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS n_cjk, len(regexp_extract_all(text, '[\\x{0900}-\\x{097f}]')) AS n_devanagari FROM documents""")
def script_profile(spark, d):
    return view(spark, d, "documents").select("doc_id", T.script_profile(F.col("text")).alias("p")).select("doc_id", "p.has_cjk", "p.has_devanagari", F.col("p.n_cjk").cast("long").alias("n_cjk"), F.col("p.n_devanagari").cast("long").alias("n_devanagari"))


@query("deliver_key", """
SELECT event_id, sha256(user_id::VARCHAR || '|' || (epoch_us(ts) // 1000)::VARCHAR || '|' || event_type || '|' || CASE WHEN event_id % 2 = 0 THEN '1' ELSE '' END) AS deliver_key FROM events""")
def deliver_key(spark, d):
    subscription = F.when(F.col("event_id") % 2 == 0, "1")
    return view(spark, d, "events").select("event_id", T.deliver_key(F.col("user_id"), F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_type"), subscription).alias("deliver_key"))


@query("redact_sender", "SELECT msg_id, CASE WHEN length(trim(sender)) <= 4 THEN '****' ELSE '****' || right(trim(sender), 4) END AS sender FROM messages", "messages")
def redact_sender(spark, d):
    return view(spark, d, "messages").select("msg_id", T.redact_sender(F.col("sender")).alias("sender"))


@query("dedupe_exact", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY coalesce(text, '')")
def dedupe_exact(spark, d):
    return dedupe.dedupe_exact(view(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("dedupe_normalized", f"SELECT min(msg_id) AS msg_id FROM messages GROUP BY {NORMAL.format('body')}", "messages")
def dedupe_normalized(spark, d):
    return dedupe.dedupe_normalized(view(spark, d, "messages").select("msg_id", "body"), "body", "msg_id").select("msg_id")


@query("dedupe_two_stage", f"SELECT count(*) AS n_rows, count(*) - count(DISTINCT body) AS removed_exact, count(DISTINCT body) - count(DISTINCT {NORMAL.format('body')}) AS removed_normalized FROM messages", "messages")
def dedupe_two_stage(spark, d):
    return dedupe.dedupe_counts(view(spark, d, "messages"), "body")


@query("index_by_id", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def index_by_id(spark, d):
    return dedupe.last_per_id(view(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("drop_eval_overlap", "SELECT id FROM labelled e WHERE msg_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM labelled t WHERE t.msg_id % 3 = 0 AND (t.id = e.id OR t.text = e.text))", "labelled")
def drop_eval_overlap(spark, d):
    rows = view(spark, d, "labelled")
    return dedupe.drop_eval_overlap(rows.filter("msg_id % 2 = 0"), rows.filter("msg_id % 3 = 0")).select("id")


def case_sql(cases: Sequence[tuple[str, str, str]], default: tuple[str, str], key: str, table: str) -> str:
    label = " ".join(f"WHEN {p} THEN '{x}'" for p, x, _ in cases)
    reason = " ".join(f"WHEN {p} THEN '{r}'" for p, _, r in cases)
    return f"SELECT {key}, CASE {label} ELSE '{default[0]}' END AS label, CASE {reason} ELSE '{default[1]}' END AS reason FROM {table}"


def has(words: Sequence[str], column: str = "t") -> str:
    return f"regexp_matches({column}, '{quoted(words)}')"


#: Texts that exercise the cascades: messages, with a known word of each list in turn, and a binary original label.
def probes(lists: Sequence[Sequence[str]]) -> str:
    flat = [w for words in lists for w in words]
    array = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in flat) + "]"
    return f"(SELECT msg_id, lower(body || ' ' || ({array})[(msg_id * 7 + msg_id // 10) % {len(flat)} + 1] || ' ' || ({array})[(msg_id * 13 + 5) % {len(flat) + 9} + 1]) AS t, CASE msg_id % 3 WHEN 0 THEN 'spam' WHEN 1 THEN 'ham' ELSE 'promo' END AS orig FROM messages)"


def probe_rows(spark, d, lists: Sequence[Sequence[str]]):
    flat = F.array(*(F.lit(w) for words in lists for w in words))
    n = sum(len(words) for words in lists)
    key = F.col("msg_id")
    first, second = F.get(flat, ((key * 7 + F.floor(key / 10)) % n).cast("int")), F.get(flat, ((key * 13 + 5) % (n + 9)).cast("int"))
    orig = F.when(key % 3 == 0, "spam").when(key % 3 == 1, "ham").otherwise("promo")
    return view(spark, d, "messages").select("msg_id", F.lower(F.concat("body", F.lit(" "), first, F.lit(" "), second)).alias("t"), orig.alias("orig")).filter("t IS NOT NULL")


def suggestion(rows, column):
    return rows.select("msg_id", column.alias("s")).select("msg_id", "s.label", "s.reason")


ZH = (W.ZH_TXN, W.ZH_TXN_BLOCKERS, W.ZH_FRAUD, W.ZH_AD, W.ZH_HARASS)
EN = (W.EN_FRAUD, W.EN_TXN, W.EN_TXN_BLOCKERS, W.EN_AD, W.EN_HARASS)
ID = (W.ID_FRAUD, W.ID_TXN, W.ID_AD, W.ID_HARASS)
HI = (W.HI_FRAUD, W.HI_TXN, W.HI_AD, W.HI_HARASS)
SPAM = "orig = 'spam'"


@query("suggest_zh", case_sql([
    (has(W.ZH_FRAUD), "FRAUD", "fraud-intent-keywords"), ("regexp_matches(t, '解冻|安全账户|异常.*点击|点击.*验证')", "FRAUD", "social-engineering-pattern"),
    (f"{has(W.ZH_TXN)} AND NOT {has((*W.ZH_TXN_BLOCKERS, *W.ZH_AD))}", "TRANSACTION", "account/order/auth/logistics-result"), (f"{has(W.ZH_TXN)} AND {has(W.ZH_HARD_TXN)}", "TRANSACTION", "hard-txn-signal-over-promo-footer"),
    (f"{has(W.ZH_AD)} OR ({SPAM} AND {has((*W.ZH_TXN_BLOCKERS, *W.ZH_AD))})", "AD", "merchant-promo"), (f"{SPAM} AND regexp_matches(t, 'http|www\\.|t\\.cn')", "AD", "spam-link-promo-candidate"),
    (has(W.ZH_HARASS), "HARASS", "collection/gray/adult/gambling"), (SPAM, "NEEDS_REVIEW", "spam-unclear")], ("NEEDS_REVIEW", "normal-unclear"), "msg_id", probes(ZH) + " WHERE t IS NOT NULL"), "messages")
def suggest_zh(spark, d):
    return suggestion(probe_rows(spark, d, ZH), W.suggest_zh(F.col("t"), F.col("orig") == "spam"))


@query("suggest_en", case_sql([
    (has(W.EN_FRAUD), "FRAUD", "fraud-intent-keywords"), ("regexp_matches(t, '" + "|".join(W.EN_FRAUD_PATTERNS) + "')", "FRAUD", "fraud-social-engineering-pattern"),
    (r"regexp_matches(t, '\b(password|pin|verify)\b') AND regexp_matches(t, '\b(claim|prize|won|urgent|account.*(suspend|frozen|lock))\b')", "FRAUD", "credential-or-urgent-scam"),
    (f"{has(W.EN_TXN)} AND NOT {has(W.EN_TXN_BLOCKERS)}", "TRANSACTION", "account/order/auth/logistics-result"), (f"{has(W.EN_TXN)} AND {has(W.EN_HARD_TXN)}", "TRANSACTION", "hard-txn-signal-over-noise"),
    (has(W.EN_AD), "AD", "merchant-or-subscription-promo"), (f"{SPAM} AND regexp_matches(t, 'http://|https://|www\\.|wap\\.') AND NOT {has(W.EN_HARASS)}", "AD", "spam-link-promo-candidate"),
    (has(W.EN_HARASS), "HARASS", "adult-dating-debt-harass"), (SPAM, "NEEDS_REVIEW", "spam-unclear-subtype")], ("NEEDS_REVIEW", "ham-personal-or-unclear"), "msg_id", probes(EN) + " WHERE t IS NOT NULL"), "messages")
def suggest_en(spark, d):
    return suggestion(probe_rows(spark, d, EN), W.suggest_en(F.col("t"), F.col("orig") == "spam"))


@query("suggest_id", case_sql([
    (has(W.ID_FRAUD), "FRAUD", "id-fraud-keywords"), (f"{has(W.ID_TXN)} AND NOT {has(W.ID_AD)}", "TRANSACTION", "id-txn-keywords"), (f"{has(W.ID_TXN)} AND {has(('otp', 'kode verifikasi', 'kode otp'))}", "TRANSACTION", "id-otp-over-promo"),
    (f"orig = 'promo' OR {has(W.ID_AD)}", "AD", "id-promo-keywords"), (has(W.ID_HARASS), "HARASS", "id-harass-keywords"), (SPAM, "NEEDS_REVIEW", "orig-spam-unclear"), ("orig = 'ham'", "NEEDS_REVIEW", "orig-normal-or-chat")],
    ("NEEDS_REVIEW", "unclear"), "msg_id", probes(ID) + " WHERE t IS NOT NULL"), "messages")
def suggest_id(spark, d):
    return suggestion(probe_rows(spark, d, ID), W.suggest_id(F.col("t"), F.col("orig")))


@query("suggest_hi", case_sql([
    (has(W.HI_FRAUD), "FRAUD", "hi-fraud-keywords"), (f"{has(W.HI_TXN)} AND NOT {has(W.HI_AD)}", "TRANSACTION", "hi-txn-keywords"), (has(W.HI_AD), "AD", "hi-ad-keywords"), (has(W.HI_HARASS), "HARASS", "hi-harass-keywords"),
    (f"{SPAM} AND regexp_matches(t, 'reply|option|which|who do you|vote')", "AD", "quiz-or-promo-spam"), (SPAM, "NEEDS_REVIEW", "spam-unclear")], ("NEEDS_REVIEW", "ham-personal-or-unclear"), "msg_id", probes(HI) + " WHERE t IS NOT NULL"), "messages")
def suggest_hi(spark, d):
    return suggestion(probe_rows(spark, d, HI), W.suggest_hi(F.col("t"), F.col("orig")))


@query("suggest_web", case_sql([("msg_id % 7 = 0", "FRAUD", "source-predicted-phishing"), ("msg_id % 5 = 0", "TRANSACTION", "source-predicted-legitimate-otp")], ("NEEDS_REVIEW", "source-success-but-not-otp-or-phishing"), "msg_id", "messages"), "messages")
def suggest_web(spark, d):
    key = F.col("msg_id")
    return suggestion(view(spark, d, "messages"), W.suggest_web(F.when(key % 7 == 0, " TRUE"), F.when(key % 5 == 0, "yes ").otherwise("no")))


@query("rule_predict", "SELECT msg_id, CASE " + " ".join(f"WHEN regexp_matches(body, '{p}', 'i') THEN '{x}'" for x, p, _ in sorted(W.RULE_PATTERNS, key=lambda r: -r[2])) + " ELSE 'TRANSACTION' END AS label FROM messages", "messages")
def rule_predict(spark, d):
    return view(spark, d, "messages").select("msg_id", W.rule_predict(T.normalize_text(F.col("body"))).alias("label"))


@query("keyword_vote", """
WITH v AS (SELECT msg_id, """ + ", ".join("[" + ", ".join(f"contains(lower(body), '{w}')::INT" for w in W.VOTE_WORDS[x]) + f"] AS {x.lower()}" for x in W.LABELS) + """ FROM messages),
s AS (SELECT msg_id, list_sum(transaction) AS a, list_sum(ad) AS b, list_sum(harass) AS c, list_sum(fraud) AS e FROM v)
SELECT msg_id, CASE greatest(a, b, c, e) WHEN a THEN 'TRANSACTION' WHEN b THEN 'AD' WHEN c THEN 'HARASS' ELSE 'FRAUD' END AS label FROM s""", "messages")
def keyword_vote(spark, d):
    return view(spark, d, "messages").select("msg_id", W.keyword_vote(T.normalize_text(F.col("body"))).alias("label"))
