"""Incremental monitoring as Structured Streaming: windowed activity with late data, and listings seen for the first time.

An extension: the batch forms are in plans. The same functions take batch or streaming frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str, late: str | None) -> DataFrame:
    """Counts and sums per user and tumbling window; on a stream, rows later than ``late`` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming and late:
        e = e.withWatermark("ts", late)
    w = e.groupBy("user_id", F.window("ts", size).alias("window")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.withColumn("window", F.struct(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end")))


def first_seen(records: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """Each key's first record; state is kept for ``late``."""
    if records.isStreaming:
        return records.withColumn("at_", F.col("fetched_at").cast("timestamp")).withWatermark("at_", late).dropDuplicatesWithinWatermark(keys).drop("at_")
    return records.dropDuplicates(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; restarted, it goes on where it ended, each row once."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
