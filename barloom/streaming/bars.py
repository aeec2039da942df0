"""Bars of an event stream; an extension, with watermarks for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, series: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """series_id, ts, open, high, low, close, volume of each window; a bar comes out when its watermark has passed. ``events`` has ts, value, event_id."""
    at = F.struct("ts", "event_id")
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), F.col(series).alias("series_id"))
    out = g.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"))
    return out.select("series_id", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
