"""Event-time windows over streams, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, length: str, by: list[str], aggregates: list[Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates of tumbling or sliding windows. Rows later than `late` are dropped by streams
    (a batch has no late rows)."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    window = F.window(time, length, slide) if slide else F.window(time, length)
    out = rows.groupBy(window.alias("_w"), *by).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], aggregates: list[Column], late: str = "10 minutes") -> DataFrame:
    """Aggregates of sessions, which end after a gap without rows."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(time, gap).alias("_w"), *by).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])
