"""Event-time windows over batch or streaming frames: the same plan serves both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, every: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums by window and keys; on a stream, rows later than late are left out."""
    if events.isStreaming and late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", every), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """Sessions of a key: they end after a gap without events."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
