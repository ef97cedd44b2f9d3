"""Metrics of event streams. Every function takes a streaming or a batch frame of the events schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LATE = "10 minutes"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Files that arrive in a folder, each read once."""
    return spark.readStream.schema(EVENTS).parquet(path)


def tumbling(events: DataFrame, width: str = "1 minute") -> DataFrame:
    """Events and mean value of each window and type; late by LATE at most."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.avg("value").alias("mean_value"))


def rolling_success(events: DataFrame, width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Success rate of sliding windows; an event of type `error` is a failure."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("events"), F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)).alias("success_rate"))


def liveness(events: DataFrame, gap: str = "300 seconds") -> DataFrame:
    """Sessions of each user without a longer silence than `gap`."""
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))


def latest(events: DataFrame) -> DataFrame:
    """Last event of each user; update or complete mode on a stream."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value", "ts"), F.struct("ts", "event_id")).alias("last"))


def without_repeats(events: DataFrame) -> DataFrame:
    """Events whose id was not seen within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def progress(events: DataFrame, steps: int = 20) -> DataFrame:
    """Running state of each user: answered, score, complete; update or complete mode on a stream."""
    out = events.groupBy("user_id").agg(F.count("*").alias("answered"), F.sum(F.coalesce("value", F.lit(0.0))).alias("score"))
    return out.withColumn("complete", F.col("answered") >= steps)
