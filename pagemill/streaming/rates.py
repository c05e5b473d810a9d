"""Windowed counts, histograms and gauges over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.params import PAGE_BOUNDS


def _start() -> Column:
    return F.unix_seconds("window.start").alias("window_start")


def sliding_counts(events: DataFrame, keys: list[str], size: str = "5 minutes", step: str = "10 seconds", delay: str = "10 minutes") -> DataFrame:
    """Events per sliding window and key."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", size, step), *keys).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(*keys, _start(), "events")


def tumbling_counts(events: DataFrame, keys: list[str], size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", size), *keys).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(*keys, _start(), "events")


def windowed_histograms(events: DataFrame, keys: list[str], value: str = "seconds", size: str = "5 minutes",
                        bounds: tuple[float, ...] = PAGE_BOUNDS, delay: str = "10 minutes") -> DataFrame:
    """Cumulative duration buckets per window and key; quantiles follow from them row by row."""
    cells = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", size), *keys).agg(*cells, F.count(value).alias("observations"))
    buckets = F.array(*[F.col(f"_b{i}") for i in range(len(bounds))], F.col("observations"))
    return counted.select(*keys, _start(), buckets.alias("cumulative"), "observations")


def gauges(samples: DataFrame, keys: list[str], value: str = "size", size: str = "10 seconds", delay: str = "10 minutes") -> DataFrame:
    """Latest sample per window and key."""
    latest = samples.withWatermark("ts", delay).groupBy(F.window("ts", size), *keys).agg(
        F.max_by(value, F.struct("ts_us", "event_id")).alias(value))
    return latest.select(*keys, _start(), value)
