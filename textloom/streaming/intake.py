"""Structured Streaming intake: parts to messages, each delivery once, classified and stored."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from textloom.functions.text import deliver_key
from textloom.operators.classify import classify_messages
from textloom.places import create_once, names_in, read_text
from textloom.sources.versions import VersionedTable


PARTS = "message_ref string, part_no long, part_count long, address string, ts timestamp, body string, subscription string"
MESSAGES = "message_ref string, address string, ts timestamp, body string, subscription string, held long, part_count long, complete boolean"


def assemble_parts(parts: DataFrame) -> DataFrame:
    """Whole messages from a table of parts (message_ref, part_no, part_count, address, ts, body, subscription).

    Bodies are joined in part order; address, time and subscription are those of the first part. Of parts with one number the
    earliest holds, then the least body. A null body counts as empty. Messages whose parts aren't all there are left out.
    """
    first = F.struct("ts", F.coalesce("body", F.lit("")).alias("body"), "address", "subscription")
    once = parts.groupBy("message_ref", "part_no").agg(F.min(first).alias("part"), F.max("part_count").alias("part_count"))
    held = once.groupBy("message_ref").agg(F.array_sort(F.collect_list(F.struct("part_no", "part.*"))).alias("parts"), F.max("part_count").alias("part_count"))
    whole = held.filter(F.size("parts") == F.col("part_count"))
    start = F.get("parts", F.lit(0))
    return whole.select("message_ref", start["address"].alias("address"), start["ts"].alias("ts"), F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("body"), start["subscription"].alias("subscription"))


class PartAssembler(StatefulProcessor):
    """Holds the parts of one message; it leaves when the last part comes, or as it is when the time for it has passed.

    A message that has left is remembered until that time, so repeats of its parts open nothing anew.
    """

    def __init__(self, wait_ms: int, late_ms: int):
        self.wait_ms, self.late_ms = wait_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part_no long", "address string, ts timestamp, body string, subscription string")
        self.progress = handle.getValueState("progress", "part_count long, left boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known, begun = self.progress.get(), timerValues.getCurrentWatermarkInMs() + self.late_ms
        count, left = known or (0, False)
        for row in rows:
            count = max(count, row.part_count or 0)
            begun = begun if row.ts is None else max(begun, int(row.ts.timestamp() * 1000))
            if not left and row.part_no is not None and not self.parts.containsKey((row.part_no,)):
                self.parts.updateValue((row.part_no,), (row.address, row.ts, row.body, row.subscription))
        if not known:
            self.handle.registerTimer(begun + self.wait_ms - self.late_ms)  # the watermark is that much behind
        if not left and count:
            held = list(self.parts.iterator())
            if len(held) >= count:
                left = True
                self.parts.clear()
                yield self._message(key, held, count, True)
        self.progress.update((count, left))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        count, left = self.progress.get() or (0, True)
        if not left:
            yield self._message(key, list(self.parts.iterator()), count, False)
        self.parts.clear()
        self.progress.clear()

    def _message(self, key, held, count, complete) -> Row:
        held.sort(key=lambda pair: pair[0][0])
        address, ts, _, subscription = held[0][1] if held else (None,) * 4
        return Row(message_ref=key[0], address=address, ts=ts, body="".join(v[2] or "" for _, v in held), subscription=subscription, held=len(held), part_count=count, complete=complete)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started in this context keep their state in RocksDB, as state with timers needs it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def assemble_stream(parts: DataFrame, delay: str = "1 hour", wait: str = "1 hour", late: str = "30 days") -> DataFrame:
    """(message_ref, address, ts, body, subscription, held, part_count, complete): messages of a stream of parts.

    A message leaves at once when its last part has come, in whatever order they came; of parts with one number the first to
    come holds. One that isn't whole a ``wait`` after the parts that opened it leaves as it is with complete false: it goes to
    a side table, see ``store_messages``. Time is the latest ts seen less ``delay``. State holds the parts of open messages and
    a mark for those that have left, for no longer than that. A part that comes later still completes its message if that is
    open, or else leaves in a row of its own after another ``wait``; Spark's watermark, behind which rows are dropped, is
    ``late`` further back. Null bodies count as empty. The session must be in ``keyed_state`` when the query starts.
    """
    rows = parts.select(*(F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(PARTS))).withWatermark("ts", f"{delay} {late}")
    wait_ms, late_ms = parts.sparkSession.range(1).select(*(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {x}")) for x in (wait, late))).first()
    return rows.groupBy("message_ref").transformWithState(PartAssembler(wait_ms, late_ms), MESSAGES, "append", "eventTime")


def store_messages(whole_path: str, side_path: str):
    """foreachBatch: whole messages to one folder, the others to another, each batch to a folder of its own, which a repeat replaces."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for path, complete in ((whole_path, True), (side_path, False)):
                rows = batch.filter(F.col("complete") == complete)
                rows.write.mode("overwrite").parquet(f"{path}/_batch={number}")
        finally:
            batch.unpersist()

    return run


def with_deliver_key(messages: DataFrame) -> DataFrame:
    return messages.withColumn("deliver_key", deliver_key(F.col("address"), F.unix_millis("ts"), F.col("body"), F.col("subscription")))


def first_deliveries(messages: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drops repeats of a delivery that come within ``watermark`` of it: a prefilter with bounded state; the store has the last word.

    Time is when a batch comes, not ``ts``: a first delivery that comes long after its ts, or has none, is no repeat, and must
    not be behind the watermark. A clock that is set back must stay within ``watermark``.
    """
    keyed = with_deliver_key(messages)
    if not keyed.isStreaming:
        return keyed.dropDuplicates(["deliver_key"])
    return keyed.withColumn("_came", F.current_timestamp()).withWatermark("_came", watermark).dropDuplicatesWithinWatermark(["deliver_key"]).drop("_came")


def unknown(deliveries: DataFrame, known: DataFrame | None) -> DataFrame:
    """``deliveries``, each once, whose key isn't among the ``known``, however old these are."""
    fresh = deliveries.dropDuplicates(["deliver_key"])
    return fresh if known is None else fresh.join(known.select("deliver_key"), "deliver_key", "left_anti").select(*deliveries.columns)


def store_deliveries(store_path: str, writer: str = "intake", buckets: int = 64):
    """foreachBatch: deliveries that the store doesn't have are added to it, so each is there as it first came.

    A batch becomes visible whole with the commit that notes it, and a repeat of it then does nothing. Of two writers that
    meet one fails, and its batch is repeated when it is started again.
    """

    def run(batch: DataFrame, number: int) -> None:
        store = VersionedTable(batch.sparkSession, store_path, [["deliver_key"]], buckets)
        base = store.snapshot()
        if not base.done(writer, number):
            store.append(unknown(batch, store.read(base)), (writer, number), base)

    return run


RESULT = ("deliver_key", "message_ref", "ts", "category", "action", "confidence", "reason", "rule_ids")


def result_store(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTable:
    """The table of results: a delivery has one, and so has a message."""
    return VersionedTable(spark, path, [["deliver_key"], ["message_ref"]], buckets)


def raw_messages(spark: SparkSession, path: str) -> DataFrame:
    """Everything that the intake has taken in whole batches, with _writer and _batch."""
    batches = [f"{path}/{w}/{b}" for w in names_in(spark, path) if w.startswith("_writer=") for b in names_in(spark, f"{path}/{w}")]
    return spark.read.option("basePath", path).parquet(*(b for b in batches if "_SUCCESS" in names_in(spark, b)))


def store_batch(raw_path: str, store_path: str, writer: str = "intake"):
    """foreachBatch: raw messages are stored first, all of them, then the results of those that the store doesn't know.

    Every step can be the last before a failure, and the batch is then repeated. The raw rows of a batch have a folder of
    their own, which is done when it says so; a repeat writes it anew only if it isn't, from the same rows. Results become
    visible with the commit that also notes the batch, so a repeat of a finished batch does nothing, whatever it would find.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        raw = f"{raw_path}/_writer={writer}/_batch={number}"
        if "_SUCCESS" not in names_in(spark, raw):
            batch.write.mode("overwrite").parquet(raw)
        store = result_store(spark, store_path)
        base = store.snapshot()
        if base.done(writer, number):
            return
        fresh = unknown(spark.read.schema(batch.schema).parquet(raw), store.read(base))
        store.upsert(classify_messages(fresh).withColumn("rule_ids", F.to_json("rule_ids")).select(*RESULT), "ts", (writer, number))

    return run


def stream_classify(messages: DataFrame, raw_path: str, store_path: str, checkpoint: str):
    """Starts the intake of a stream of messages; available data is processed, then it stops.

    Batches are numbered for each checkpoint, so a checkpoint keeps the name under which its batches are known.
    """
    spark, name = messages.sparkSession, f"{checkpoint}/intake-writer"
    create_once(spark, name, uuid.uuid4().hex)
    run = store_batch(raw_path, store_path, read_text(spark, name))
    return first_deliveries(messages).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def action_counts(results: DataFrame, every: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """(window_start, action, n): tumbling counts for operations."""
    rows = results.withWatermark("ts", watermark) if results.isStreaming else results
    return rows.groupBy(F.window("ts", every), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "action", "n")
