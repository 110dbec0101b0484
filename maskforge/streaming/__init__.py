"""Run records as a stream: summaries that are kept up to date as runs finish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Number of runs, mean accuracy and mean time per keys, of a stream or a table; states are sums, as many as keys."""
    return records.groupBy(*keys).agg(F.count("*").alias("runs"), F.avg("acc").alias("acc_mean"), F.avg("time").alias("time_mean"))


def windowed(events: DataFrame, time: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Counts and sums of ``value`` per time window and keys; rows later than ``late`` are left out of a stream."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs a stream over what is there now, and ends."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
