"""Keyed state and timers of the part assembler, through real streams."""

import random
import time

from pyspark.sql import functions as F

from textloom.operators.allowlist import allowed_by_act, stream_allowed_by_act
from textloom.streaming import intake


def run(spark, tmp_path, batches, **options):
    """Streams ``batches`` of parts one by one; (whole, side) rows with the batch they left in."""
    for rows in batches:
        frame = spark.createDataFrame(rows, intake.PARTS.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole, side = str(tmp_path / "whole"), str(tmp_path / "side")
    with intake.keyed_state(spark):
        writer = intake.assemble_stream(stream, **options).writeStream.foreachBatch(intake.store_messages(whole, side))
        writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return [sorted(((r["_batch"], r.message_ref, r.address, r.body, r.held) for r in spark.read.parquet(path).collect()), key=repr) for path in (whole, side)]


def test_messages_leave_when_whole_or_when_their_time_has_passed(spark, tmp_path):
    batches = [
        [("m", 2, 2, "b", "2024-01-01 10:00:10", "two", "1"), ("gone", 1, 3, "g", "2024-01-01 10:00:00", "a", None), ("gone", 3, 3, "h", "2024-01-01 10:01:00", "c", None), ("late", 2, 2, "l", "2024-01-01 10:00:00", "end", None)],
        [("m", 1, 2, "a", "2024-01-01 09:59:50", "one ", "1"), ("m", 1, 2, "x", "2024-01-01 09:59:50", "other ", "1"), ("one", 1, 1, "o", "2024-01-01 10:02:00", None, None)],
        [("m", 2, 2, "b", "2024-01-01 10:00:10", "two", "1"), ("clock", 1, 9, None, "2024-01-01 12:30:00", "tick", None)],
        # The watermark has passed these; the timer hasn't run yet.
        [("late", 1, 2, "k", "2024-01-01 10:00:00", "begin ", None), ("clock", 2, 9, None, "2024-01-01 12:31:00", "tick", None)],
        # After the message left as it was: a piece of its own.
        [("gone", 2, 3, "z", "2024-01-01 10:00:30", "b", None), ("end", 1, 1, "e", "2024-01-02 10:00:00", "x", None)],
    ]
    whole, side = run(spark, tmp_path, batches)
    assert [r[1:] for r in whole] == [("m", "a", "one two", 2), ("one", "o", "", 1), ("late", "k", "begin end", 2), ("end", "e", "x", 1)]
    assert [r[0] for r in whole][:3] == [1, 1, 3]  # at once, not when the watermark passes
    assert [r[1:] for r in side] == [("gone", "g", "ac", 2), ("clock", None, "ticktick", 2), ("gone", "z", "b", 1)]


def test_odd_parts(spark, tmp_path):
    batches = [
        [(None, 1, 1, "a", "2024-01-01 10:00:00", "no name", None), ("none", None, None, "a", "2024-01-01 10:00:00", "x", None), ("time", 1, 1, "a", None, "no time", None), ("long", 1, 2, "a", "2024-01-01 10:00:00", "x" * 100_000, None)],
        [("long", 2, 2, "a", "2024-01-01 10:00:00", "y", None)],
        [("end", 1, 1, "e", "2024-01-02 10:00:00", "x", None)],
    ]
    whole, side = run(spark, tmp_path, batches, wait="10 minutes")
    assert {(r[1], r[4], len(r[3])) for r in whole} == {(None, 1, 7), ("time", 1, 7), ("long", 2, 100_001), ("end", 1, 1)}
    assert [(r[1], r[4]) for r in side] == [("none", 0)]


def test_table_of_parts(spark):
    rows = [("m", 2, 2, "b", "2024-01-01 10:00:10", "two", "1"), ("m", 1, 2, "a", "2024-01-01 09:59:50", "one ", "1"), ("m", 1, 2, "a", "2024-01-01 09:59:51", "again ", "2"), ("half", 1, 2, "a", "2024-01-01 10:00:00", "x", None), ("null", 1, 1, None, None, None, None)]
    frame = spark.createDataFrame(rows, intake.PARTS.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.message_ref, r.address, r.body, r.subscription) for r in intake.assemble_parts(frame).collect()) == [("m", "a", "one two", "1"), ("null", None, "", None)]
    assert intake.assemble_parts(frame.limit(0)).collect() == []


def random_events(n=400):
    rng = random.Random(12)
    start = 1_700_000_000
    messages = [(k, rng.choice([None, 1, 2, 3]), start + rng.randrange(20_000)) for k in range(n)]
    acts = [(rng.choice([None, 1, 2, 3]), start + rng.randrange(20_000)) for _ in range(30)]
    edge = [(n, 9, start + 1800), (n + 1, 9, start + 1801), (n + 2, 9, start - 1), (n + 3, 9, start), (n + 3, 9, start), (n + 4, 9, None)]
    return messages + edge, [*acts, (9, start), (9, start), (9, None)]


def expected_allowed(messages, acts):
    return sorted((m, u is not None and t is not None and any(a == u and s is not None and t - 1800 <= s <= t for a, s in acts)) for m, u, t in messages)


def frames(spark, messages, acts):
    at = F.timestamp_seconds(F.col("s")).alias("ts")
    return spark.createDataFrame(messages, "message_id long, user_id long, s long").select("message_id", "user_id", at), spark.createDataFrame(acts, "user_id long, s long").select("user_id", at)


def test_acts_allow_messages_for_half_an_hour(spark):
    messages, acts = random_events()
    got = allowed_by_act(*frames(spark, messages, acts))
    assert sorted(map(tuple, got.collect())) == expected_allowed(messages, acts)
    assert allowed_by_act(*(f.limit(0) for f in frames(spark, messages, acts))).collect() == []


def test_two_streams_meet_and_messages_without_an_act_leave_in_time(spark, tmp_path):
    messages, acts = random_events(60)
    messages = list(dict.fromkeys(m for m in messages if m[2] is not None))
    end = 1_700_000_000 + 200_000
    batches = [(messages[::2], acts[::2]), (messages[1::2], acts[1::2]), ([(-1, -1, end)], [(-2, end)])]
    for rows in batches:  # acts come before and after the messages they allow
        for name, frame in zip(("m", "a"), frames(spark, *rows), strict=True):
            frame.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        time.sleep(1.1)
    streams = [spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in ("m", "a")]
    stream_allowed_by_act(*streams).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.message_id, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [r for r in got if r[0] >= 0] == expected_allowed(messages, acts)


def arrive(spark, tmp_path, n, rows):
    """Rows of batch ``n``, (message_ref, ts or None), from one sender with one body for all."""
    frame = spark.createDataFrame(rows, "message_ref string, at string").select("message_ref", F.lit("a").alias("address"), F.col("at").cast("timestamp").alias("ts"), F.lit("b").alias("body"), F.lit(None).cast("string").alias("subscription"))
    frame.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{n}"))
    time.sleep(1.1)
    return frame.schema


def test_first_deliveries_that_come_late_are_kept_and_old_repeats_are_not(spark, tmp_path):
    """A run of its own has none of the state of those before, as after the watermark; then only the store knows a delivery."""
    store = str(tmp_path / "store")
    runs = [
        [[("m1", "2024-01-02 00:00:00"), ("m1 again", "2024-01-02 00:00:00")], [("m1 again", "2024-01-02 00:00:00")], [("late", "2024-01-01 00:00:00"), ("m1 again", "2024-01-02 00:00:00")], [("no time", None), ("no time again", None)]],
        [[("m1 old", "2024-01-02 00:00:00"), ("late old", "2024-01-01 00:00:00"), ("m2", "2023-01-01 00:00:00")], [("no time old", None)]],
    ]
    for k, batches in enumerate(runs):
        for rows in batches:
            schema = arrive(spark, tmp_path, k, rows)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in-{k}"))
        with intake.keyed_state(spark):
            writer = intake.first_deliveries(stream).writeStream.foreachBatch(intake.store_deliveries(store, f"run-{k}", 4))
            writer.option("checkpointLocation", str(tmp_path / f"c-{k}")).trigger(availableNow=True).start().awaitTermination()
    table = intake.VersionedTable(spark, store, [["deliver_key"]])
    kept = sorted(r.message_ref.removesuffix(" again") for r in table.read().collect())
    assert kept == ["late", "m1", "m2", "no time"] and table.read().columns == [*schema.names, "deliver_key"]
    # A batch that is known adds nothing, whatever it brings.
    before = table.versions()
    intake.store_deliveries(store, "run-0", 4)(intake.with_deliver_key(spark.read.parquet(str(tmp_path / "in-1")).limit(1)), 0)
    assert table.versions() == before


def test_messages_that_come_late_are_classified(spark, tmp_path):
    """The watermark drops rows from the second batch after the one that moves it."""
    for rows in ([("m1", "2024-01-02 00:00:00")], [("m2", "2024-01-02 00:00:01")], [("late", "2024-01-01 00:00:00"), ("m1", "2024-01-02 00:00:00")]):
        schema = arrive(spark, tmp_path, 0, rows)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in-0"))
    intake.stream_classify(stream, str(tmp_path / "raw"), str(tmp_path / "store"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.message_ref for r in intake.result_store(spark, str(tmp_path / "store")).read().collect()) == ["late", "m1", "m2"]
