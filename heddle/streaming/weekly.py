"""Windows of events as a stream: an extension, beside the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """user_id, event_type, week (start), n; works on batches and on streams."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = events.withWatermark("ts", late) if events.isStreaming else events
    counted = held.groupBy(F.window("ts", "7 days").alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"))
    return counted.select("user_id", "event_type", F.col("w.start").alias("week"), "n")


def append_stream(frame: DataFrame, path: str, checkpoint: str):
    """Append finished windows as Parquet, as far as the source goes now."""
    return frame.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
