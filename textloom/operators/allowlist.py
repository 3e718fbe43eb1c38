"""Messages that follow an act of their receiver within a span of time, on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allowed_by_act(messages: DataFrame, acts: DataFrame, within: str = "30 minutes") -> DataFrame:
    """(message_id, allowed) of ``messages`` (message_id, user_id, ts): whether ``acts`` (user_id, ts) has one at most ``within`` before.

    Time is cut into spans of ``within``: acts count for their span and the next, a message looks back inside its own, so a
    task holds a user's acts of two spans and never a whole history, and no pairs are made. A null user or time is never
    allowed. Rows of ``messages`` that repeat each get a row.
    """
    span = messages.sparkSession.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {within}"))).first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    known = messages.select("message_id", "user_id", at.alias("us")).withColumn("span", F.floor(F.col("us") / span)).withColumn("act", F.lit(False))
    once = acts.filter("user_id IS NOT NULL").select(F.lit(None).cast(known.schema["message_id"].dataType).alias("message_id"), "user_id", at.alias("us")).filter("us IS NOT NULL").distinct()
    spread = once.withColumn("span", F.explode(F.array(F.floor(F.col("us") / span), F.floor(F.col("us") / span) + 1))).withColumn("act", F.lit(True))
    whole = known.filter("user_id IS NOT NULL AND us IS NOT NULL")
    back = Window.partitionBy("user_id", "span").orderBy("us").rangeBetween(-span, 0)
    found = whole.unionByName(spread).withColumn("allowed", F.max("act").over(back)).filter("NOT act")
    rest = known.filter("user_id IS NULL OR us IS NULL").withColumn("allowed", F.lit(False))
    return found.unionByName(rest).select("message_id", "allowed")


def stream_allowed_by_act(messages: DataFrame, acts: DataFrame, within: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """The same of two streams, each with a watermark of ``delay``: an interval join that keeps messages without an act.

    A message that an act allows leaves with the first such act to come, in whatever order both arrive; one that none allows
    leaves when both watermarks have passed it. State holds a message, or an act, until no partner can come. Each message_id
    leaves once.
    """
    left = messages.select("message_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    right = acts.select(F.col("user_id").alias("act_user"), F.col("ts").cast("timestamp").alias("act_ts")).withWatermark("act_ts", delay)
    met = F.expr(f"user_id = act_user AND act_ts <= ts AND act_ts >= ts - INTERVAL {within}")
    joined = left.join(right, met, "left_outer").select("message_id", "ts", F.col("act_ts").isNotNull().alias("allowed"))
    return joined.dropDuplicatesWithinWatermark(["message_id"])
