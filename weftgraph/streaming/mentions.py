"""Streaming forms of mention counting and of the first sight of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mentions(stream: DataFrame, entity: str, ts: str, window: str = "1 hour", late: str = "10 minutes", least: int = 3) -> DataFrame:
    """Entities mentioned at least ``least`` times in an event-time window; rows later than the watermark are dropped."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(entity).alias("entity")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).select(F.col("window.start").alias("window_start"), "entity", "n")


def first_seen(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first row of every key within the watermark; state older than it is dropped."""
    return stream.where(F.col(key).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
