"""Incremental scans and audit counts as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HITS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stage_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs and time by stage and tumbling window; rows later than ``late`` are dropped by the watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window), F.col("event_type").alias("stage"))
        .agg(F.count("*").alias("runs"), F.sum("value").alias("ms"))
        .select(F.col("window.start").alias("start"), "stage", "runs", "ms")
    )


def first_contents(documents: DataFrame) -> DataFrame:
    """The first row of each content among arriving documents (an ``at`` time bounds the state)."""
    return documents.withColumn("sha256", F.sha2("text", 256)).withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["sha256"])


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs the stream over what has arrived, then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
