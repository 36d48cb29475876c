"""Native event-time forms: windowed aggregation with late data, sessions, and deduplicated readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(readings: DataFrame, length: str, late: str, by: tuple[str, ...] = ("stream",)) -> DataFrame:
    """by, window, n, mean of readings (ts, v) that come no later than ``late`` behind the newest."""
    w = F.window("ts", length)
    return readings.withWatermark("ts", late).groupBy(*by, w).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def sessions(readings: DataFrame, gap: str, late: str, by: tuple[str, ...] = ("stream",)) -> DataFrame:
    return readings.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def distinct_readings(readings: DataFrame, late: str, keys: tuple[str, ...]) -> DataFrame:
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
