"""Streaming variants over an event stream: windows with watermarks, and mention runs with a budget.

They go beyond the batch operators: state is kept by Spark, late rows are dropped past the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_events(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type."""
    w = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return w.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no longer pause than ``gap``: the budget of words as one of time."""
    w = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return w.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
