"""Extension: the event log as a stream. The batch semantics are the same functions on static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE, GAP, WIDTH = "30 minutes", "30 minutes", "1 hour"


def read_events(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 8) -> DataFrame:
    """A file source; times become instants, as watermarks ask for."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = LATE, width: str = WIDTH) -> DataFrame:
    """Counts and sums by type and tumbling window."""
    base = events.withWatermark("ts", late) if events.isStreaming else events
    return base.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """Sessions of a user, closed by a gap."""
    base = events.withWatermark("ts", late) if events.isStreaming else events
    return base.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    """Events without repeats that come within the lateness."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
