"""Streams of training metrics and pen events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, which needs times with a zone (the session's); tables stay as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def window_losses(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Mean value and count per time window and type, with a watermark for late rows."""
    return timed(events, late).groupBy(F.window("ts", size), "event_type").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Pen sessions: a user's events with no longer gap than that. Runs on batches and streams."""
    return timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_points"), F.min("ts").alias("first_ts"))
