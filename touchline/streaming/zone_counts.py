"""Structured Streaming: actions a zone and window, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalar import zone


def zone_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes", nx: int = 12, ny: int = 8) -> DataFrame:
    """window start, zone, n of events(<time>, x, y normalised); works on streams and tables alike."""
    z = (zone(F.col("y"), ny) * nx + zone(F.col("x"), nx)).alias("zone")
    return events.withWatermark(time, late).groupBy(F.window(time, window), z).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "zone", "n")
