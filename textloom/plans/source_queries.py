"""Queries over what is read from files or arrives by stream, and over synthetic and augmented rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import synthesis
from textloom.operators.allowlist import stream_allowed_by_act
from textloom.places import names_in, shared_folder, size_of
from textloom.plans.message_queries import ROUTED, purchases_and_clicks
from textloom.plans.views import pieces, query, view
from textloom.sources import readers
from textloom.sources.versions import VersionedTable
from textloom.streaming import intake


@query("read_vendor_corpus", "SELECT o_orderkey, 'text ' || o_orderkey AS text, CASE o_orderstatus WHEN 'O' THEN 'ham' WHEN 'F' THEN 'spam' ELSE lower(o_orderstatus) END AS label FROM orders")
def read_vendor_corpus(spark, d):
    rows = view(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("text "), F.col("o_orderkey").cast("string"))).alias("Teks"), F.concat(F.lit(" text "), F.col("o_orderkey").cast("string")).alias("text"), F.col("o_orderstatus").alias("label"))
    out = readers.read_vendor_corpus(rows, ("Teks", "teks", "text"), ("label",), {"o": "ham", "f": "spam"})
    return out.withColumn("o_orderkey", F.substring_index("text", " ", -1).cast("long"))


@query("read_weak_label_candidates", """
WITH c AS (SELECT msg_id, trim(body) AS t, CASE WHEN msg_id % 5 = 0 THEN 'failed' ELSE 'success' END AS s, msg_id % 11 = 0 AS e FROM messages)
SELECT 'status' AS reason, count(*) AS n FROM c WHERE s <> 'success' UNION ALL SELECT 'empty', count(*) FROM c WHERE s = 'success' AND e
UNION ALL SELECT 'good', count(*) FROM c WHERE s = 'success' AND NOT e UNION ALL SELECT 'kept', count(DISTINCT t) FROM c WHERE s = 'success' AND NOT e""", "messages")
def read_weak_label_candidates(spark, d):
    key = F.col("msg_id")
    rows = view(spark, d, "messages").select("msg_id", F.when(key % 11 != 0, F.col("body")).alias("sms_text"), F.when(key % 5 == 0, "failed").otherwise("success").alias("classification_status"), "sender")
    return readers.weak_candidates(rows, "msg_id")[1]


@query("augment_train", """
WITH t AS (SELECT id, replace(text, ' ', '，') AS text, ('0x' || substr(md5('42:width:' || id), 1, 8))::BIGINT AS w, ('0x' || substr(md5('42:comma:' || id), 1, 8))::BIGINT AS c FROM labelled WHERE label <> 'NEEDS_REVIEW'),
a AS (SELECT *, CASE WHEN w % 2 = 0 THEN substr(text, 1, (w // 2) % length(text)) || chr(8203 + (w % 3)::INT) || substr(text, (w // 2) % length(text) + 1) ELSE text END AS x FROM t),
b AS (SELECT *, CASE WHEN c % 2 = 0 THEN replace(x, '，', ' ， ') ELSE x END AS y FROM a)
SELECT id || '-aug-1' AS id, id AS parent_id, y AS text FROM b WHERE y <> text""", "labelled")
def augment_train(spark, d):
    rows = view(spark, d, "labelled").filter("label <> 'NEEDS_REVIEW'").select("id", F.replace("text", F.lit(" "), F.lit("，")).alias("text"))
    return synthesis.augment(rows, 42).filter("is_adversarial").select("id", "parent_id", "text")


TEMPLATES = [("en", "TRANSACTION", "code {n}"), ("en", "AD", "offer {n}"), ("en", "FRAUD", "verify {n}"), ("zh", "TRANSACTION", "验证码 {n}"), ("hi", "HARASS", "pay me {n}"), ("id", "AD", "promo {n}")]


@query("synthesize_messages", """
SELECT language || '-' || k || '-' || n AS id, language, label, 'snd-' || language || '-' || n % 5 AS sender_group, 'tpl-' || language || '-' || k AS template_group, said || ((('0x' || substr(md5('42:' || k || ':' || n), 1, 8))::BIGINT) % 900000 + 100000) AS text
FROM (VALUES (0, 'en', 'TRANSACTION', 'code '), (1, 'en', 'AD', 'offer '), (2, 'en', 'FRAUD', 'verify '), (3, 'zh', 'TRANSACTION', '验证码 '), (4, 'hi', 'HARASS', 'pay me '), (5, 'id', 'AD', 'promo ')) t(k, language, label, said), (SELECT p_partkey AS n FROM part) p""")
def synthesize_messages(spark, d):
    return synthesis.synthesize(view(spark, d, "part").select(F.col("p_partkey").alias("n")), TEMPLATES, 42)


def streamed(spark, frame, name: str):
    """``frame`` written to files and read as a stream."""
    folder = shared_folder(spark, name)
    frame.write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def finished(spark, stream, name: str, mode: str = "append"):
    """Runs a stream over all that is there, to files, and reads these."""
    out = shared_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_folder(spark, f"{name}-state")).trigger(availableNow=True)
    writer.format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: What comes a day after all else, so that the watermark passes all before it.
LAST = "2100-01-01"


def conversation_parts(spark, d):
    """Each conversation's turns as the parts of a message, half an hour apart."""
    parts = view(spark, d, "conversations")
    n = parts.groupBy("conv_id").agg(F.count("*").alias("part_count"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 1800)
    return parts.join(n, "conv_id").select(F.col("conv_id").cast("string").alias("message_ref"), F.col("turn").alias("part_no"), "part_count", F.col("role").alias("address"), at.alias("ts"), F.col("text").alias("body"), F.lit(None).cast("string").alias("subscription"))


@query("assemble_parts", "SELECT conv_id AS message_ref, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS body FROM conversations GROUP BY conv_id")
def assemble_parts(spark, d):
    """Messages from a table of parts, every third of which comes twice."""
    parts = conversation_parts(spark, d)
    whole = intake.assemble_parts(parts.unionByName(parts.filter("part_no % 3 = 0")))
    return whole.select(F.col("message_ref").cast("long").alias("message_ref"), F.sha2("body", 256).alias("body"))


@query("stream_assemble_parts", """
SELECT conv_id AS message_ref, count(*) AS held, count(*) = any_value(n) AS complete, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS body
FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE conv_id % 5 <> 0 OR turn <> 0 GROUP BY conv_id""")
def stream_assemble_parts(spark, d):
    """The parts of messages through a stream with keyed state: later parts come first, every third twice, and every fifth
    message lacks its first part, so that it leaves when its time has passed. A last part far ahead lets that time pass."""
    parts = conversation_parts(spark, d).filter("CAST(message_ref AS BIGINT) % 5 <> 0 OR part_no <> 0")
    later = parts.limit(1).withColumn("message_ref", F.lit("-1")).withColumn("part_count", F.lit(2).cast("long")).withColumn("ts", F.lit(LAST).cast("timestamp"))
    first = parts.filter("part_no % 2 = 1")
    rest = parts.filter("part_no % 2 = 0").unionByName(parts.filter("part_no % 3 = 0"))
    folder = shared_folder(spark, "parts")
    for rows in (first, rest, later):
        rows.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(parts.schema).parquet(folder)
    whole, side = shared_folder(spark, "messages"), shared_folder(spark, "incomplete")
    with intake.keyed_state(spark):
        writer = intake.assemble_stream(stream).writeStream.foreachBatch(intake.store_messages(whole, side)).option("checkpointLocation", shared_folder(spark, "parts-state"))
        writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(whole).unionByName(spark.read.parquet(side))
    return rows.select(F.col("message_ref").cast("long").alias("message_ref"), "held", "complete", F.sha2("body", 256).alias("body"))


def deliveries(spark, d):
    events = view(spark, d, "events").select(F.col("user_id").cast("string").alias("address"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("body"), F.when(F.col("event_id") % 2 == 0, "1").alias("subscription"), "event_id")
    return events.withColumn("again", F.lit(False)).unionByName(events.filter("event_id % 10 = 0").withColumn("again", F.lit(True)))


def write_files(spark, rows, folder: str, files: int, key: str) -> None:
    """Adds ``rows`` to a folder as exactly ``files`` files, by the hash of ``key``: a stream of so many files at once takes them as one batch."""
    wanted = parts_in(spark, folder) + files
    rows.repartition(files, key).write.mode("append").parquet(folder)
    for _ in range(wanted - parts_in(spark, folder)):  # a file that no row fell to isn't written
        rows.limit(0).coalesce(1).write.mode("append").parquet(folder)


def parts_in(spark, folder: str) -> int:
    return sum(name.startswith("part-") for name in names_in(spark, folder))


KEYS = "(SELECT DISTINCT user_id::VARCHAR || '|' || (epoch_us(ts) // 1000)::VARCHAR || '|' || event_type || '|' || CASE WHEN event_id % 2 = 0 THEN '1' ELSE '' END AS k FROM events)"


@query("stream_idempotent", f"SELECT sha256(k) AS deliver_key FROM {KEYS}")
def stream_idempotent(spark, d):
    """Deliveries of which every tenth comes twice, in four batches, the times of a later one before those of an earlier.

    Two batches are one run, and the other run begins without its state. Repeats come in the same batch, in another of the
    run, or in the other run, where only the store knows them. The store is the result.
    """
    rows = deliveries(spark, d)
    first, last = rows.agg(F.coalesce(F.min(F.unix_micros("ts")), F.lit(0)), F.coalesce(F.max(F.unix_micros("ts")), F.lit(0))).first()
    quarter = F.coalesce(F.floor((F.unix_micros("ts") - first) * 4 / F.lit(max(1, last - first + 1))).cast("int"), F.lit(0))
    after = F.when(F.col("again"), F.col("event_id") / 10).otherwise(0).cast("long")
    part = F.pmod(F.get(F.array(*map(F.lit, (1, 3, 0, 2))), quarter) + after, F.lit(4))
    source = f"{d}/events.parquet"
    files, buckets, store = max(1, size_of(spark, source) // (8 << 20)), max(8, pieces(spark, source)), shared_folder(spark, "first")
    for run in range(2):
        folder = shared_folder(spark, "deliveries")
        for k in (2 * run, 2 * run + 1):
            write_files(spark, rows.filter(part == k).drop("again"), folder, files, "event_id")
        stream = spark.readStream.schema(rows.drop("again").schema).option("maxFilesPerTrigger", files).parquet(folder)
        with intake.keyed_state(spark):
            writer = intake.first_deliveries(stream).writeStream.foreachBatch(intake.store_deliveries(store, f"run-{run}", buckets))
            writer.option("checkpointLocation", shared_folder(spark, "first-state")).trigger(availableNow=True).start().awaitTermination()
    return VersionedTable(spark, store, [["deliver_key"]]).read().select("deliver_key")


@query("stream_action_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type AS action, count(*) AS n FROM events GROUP BY ALL")
def stream_action_counts(spark, d):
    rows = view(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"))
    later = rows.limit(1).withColumn("ts", F.lit(LAST).cast("timestamp"))
    counted = finished(spark, intake.action_counts(streamed(spark, rows.unionByName(later), "actions")), "counts")
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_classify", f"SELECT sha256(msg_id || '|' || (epoch_us(ts) // 1000) || '|' || body || '|') AS deliver_key, category, action, reason FROM (WITH {ROUTED} SELECT m.msg_id, m.ts, m.body, c.category, c.action, c.reason FROM c JOIN messages m ON c.msg_id = m.msg_id)", "messages")
def stream_classify(spark, d):
    """Messages, every seventh delivered twice, through the intake: each is stored once. The store is the result."""
    rows = view(spark, d, "messages").select(F.col("msg_id").cast("string").alias("message_ref"), F.col("msg_id").cast("string").alias("address"), F.col("ts").cast("timestamp").alias("ts"), "body", F.lit(None).cast("string").alias("subscription"))
    twice = rows.unionByName(rows.filter("CAST(message_ref AS BIGINT) % 7 = 0"))
    raw, store = shared_folder(spark, "raw"), shared_folder(spark, "store")
    intake.stream_classify(streamed(spark, twice, "intake"), raw, store, shared_folder(spark, "intake-state")).awaitTermination()
    return intake.result_store(spark, store).read().select("deliver_key", "category", "action", "reason")


@query("stream_temporal_allowlist", "SELECT m.event_id, count(a.ts) > 0 AS allowed FROM events m LEFT JOIN events a ON a.user_id = m.user_id AND a.event_type = 'click' AND a.ts BETWEEN m.ts - INTERVAL 30 MINUTE AND m.ts WHERE m.event_type = 'purchase' GROUP BY m.event_id")
def stream_temporal_allowlist(spark, d):
    """Purchases and clicks as two streams joined by user and time; a last pair far ahead lets both watermarks pass."""
    streams = []
    for name, rows in zip(("purchases", "clicks"), purchases_and_clicks(spark, d), strict=True):
        later = rows.limit(1).withColumn("user_id", F.lit(-len(streams) - 1).cast(rows.schema["user_id"].dataType)).withColumn("ts", F.lit(LAST).cast("timestamp"))
        streams.append(streamed(spark, rows.unionByName(later if streams else later.withColumn("message_id", -F.col("message_id") - 1)), name))
    found = finished(spark, stream_allowed_by_act(*streams), "allowed")
    return found.filter("message_id >= 0").select(F.col("message_id").alias("event_id"), "allowed")


#: Stored results with a delivery key, and changes to them: some are new, some bring a message again, some a delivery of another.
KEYED = "SELECT message_uri, 'd' || message_uri AS deliver_key, action, created_at, 0 AS step FROM store"
CHANGED = """SELECT msg_id AS message_uri, 'd' || CASE WHEN msg_id % 4 = 0 THEN msg_id + 3 ELSE msg_id END AS deliver_key, 'REVIEW' AS action, msg_id * 1000 + 1 AS created_at, 1 + msg_id % 3 AS step FROM labelled WHERE msg_id % 6 < 4
UNION ALL SELECT -msg_id, 'd' || msg_id, 'INBOX', msg_id * 1000 + 2, 3 FROM labelled WHERE msg_id % 7 = 0"""


@query("classification_versions", f"""
SELECT message_uri, deliver_key, action, created_at FROM (SELECT *, max(place) OVER (PARTITION BY message_uri) AS by_uri, max(place) OVER (PARTITION BY deliver_key) AS by_key
  FROM (SELECT *, step::BIGINT * 1000000000000 + created_at AS place FROM ({KEYED} UNION ALL {CHANGED})))
WHERE place = by_uri AND place = by_key""", "store", "labelled")
def classification_versions(spark, d):
    """The result store in four commits, the last one repeated: a message and a delivery have one row each, the latest put in."""
    frames = {n: view(spark, d, n) for n in ("store", "labelled")}
    known, changes = (spark.sql(text.replace("FROM store", "FROM {store}").replace("FROM labelled", "FROM {labelled}"), **{n: f for n, f in frames.items() if n in text}) for text in (KEYED, CHANGED))
    buckets = max(8, pieces(spark, f"{d}/orders.parquet"))  # a bucket is written by one task
    table = VersionedTable(spark, shared_folder(spark, "versions"), [["message_uri"], ["deliver_key"]], buckets)
    columns = ["message_uri", "deliver_key", "action", "created_at"]
    for step, rows in enumerate([known, *(changes.filter(F.col("step") == k) for k in (1, 2, 3, 3))]):
        table.upsert(rows.select(*columns), "created_at", ("query", min(step, 3)))
    return table.read()
