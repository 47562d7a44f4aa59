"""Streams of events: windows with watermarks, sessions, and repeated events.

The dialect has no stream semantics of its own; these are the table operators
over event time, written so that the same function serves a batch and a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their value by window and type; tumbling, or sliding with ``slide``."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    found = _timed(events, late).groupBy(span, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with less than ``gap`` between."""
    found = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each event once, by ``keys``; on a stream, state is kept as long as the watermark allows."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished rows as Parquet, exactly once, until the input is used up."""
    return df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
