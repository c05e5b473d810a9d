"""Counters, duration histograms, quantiles, rates and gauges from event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.params import PAGE_BOUNDS, Params

WINDOW_S, STEP_S, GAUGE_S = 300, 10, 10


def page_outcome_counts(events: DataFrame) -> DataFrame:
    """Pages by status and type; a page without a type keeps null."""
    return events.groupBy("status", "doc_type").agg(F.count(F.lit(1)).alias("pages"))


def document_status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def error_counts(events: DataFrame) -> DataFrame:
    return events.where("error_type IS NOT NULL").groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))


def bucket_start(ts_us: str, size_s: int) -> Column:
    """Start of the aligned tumbling window, epoch seconds."""
    return F.expr(f"CAST(floor({ts_us} / {size_s * 1_000_000}D) AS BIGINT) * {size_s}")


def histogram_arrays(rows: DataFrame, keys: list[str], value: str = "seconds", bounds: tuple[float, ...] = PAGE_BOUNDS) -> DataFrame:
    """Cumulative bucket counts (bounds plus the open last bucket), sum and count per key in one aggregation."""
    cumulative = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    counted = rows.groupBy(*keys).agg(*cumulative, F.count(value).alias("observations"), F.sum(value).alias("total"))
    buckets = F.array(*[F.col(f"_b{i}") for i in range(len(bounds))], F.col("observations"))
    return counted.select(*keys, buckets.alias("cumulative"), "observations", "total")


def histogram_rows(histograms: DataFrame, keys: list[str], bounds: tuple[float, ...] = PAGE_BOUNDS) -> DataFrame:
    """One row per bucket; ``le`` is the bound as text, '+Inf' for the last."""
    labels = F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf"))
    cells = F.arrays_zip(labels.alias("le"), F.col("cumulative"))
    return histograms.select(*keys, "observations", "total", F.inline(cells).alias("le", "cumulative"))


def bucket_quantile(cumulative: Column, share: float, bounds: tuple[float, ...] = PAGE_BOUNDS) -> Column:
    """Quantile interpolated inside the first bucket that reaches the rank.

    Null for an empty histogram; the last finite bound when the rank falls in the open bucket.
    """
    edges = F.array(F.lit(0.0), *[F.lit(float(b)) for b in bounds])
    last = len(bounds)
    total = F.get(cumulative, F.lit(last))
    rank = total * F.lit(share)
    index = (F.array_position(F.transform(cumulative, lambda c: c >= rank), F.lit(True)) - 1).cast("int")
    below = F.when(index == 0, F.lit(0)).otherwise(F.get(cumulative, index - 1))
    inside = F.get(cumulative, index) - below
    low, high = F.get(edges, index), F.get(edges, index + 1)
    value = F.when(index == last, F.lit(float(bounds[-1]))).otherwise(low + (high - low) * F.try_divide(rank - below, inside))
    return F.when(total > 0, value)


def windowed_quantiles(rows: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5, 0.95), size_s: int = WINDOW_S,
                       value: str = "seconds", bounds: tuple[float, ...] = PAGE_BOUNDS) -> DataFrame:
    """p50 and p95 (or other shares) per tumbling window."""
    windowed = rows.withColumn("window_start", bucket_start("ts_us", size_s))
    histograms = histogram_arrays(windowed, [*keys, "window_start"], value, bounds)
    quantiles = [bucket_quantile(F.col("cumulative"), s, bounds).alias(f"p{round(s * 100)}") for s in shares]
    return histograms.select(*keys, "window_start", "observations", *quantiles)


def counter_rates(samples: DataFrame, keys: list[str], size_s: int = WINDOW_S) -> DataFrame:
    """Increase and rate of a counter per window; a fall is a reset, after which the new value counts.

    Differences are taken inside each (series, window), whose size is set by the sampling interval. The step
    from one window to the next uses only each window's first and last sample, so no series is sorted as a whole.
    """
    at = F.struct("ts_us", "event_id")
    windowed = samples.withColumn("window_start", bucket_start("ts_us", size_s))
    inside = Window.partitionBy(*keys, "window_start").orderBy("ts_us", "event_id")

    def step(value: Column, previous: Column) -> Column:
        return F.when(value < previous, value).otherwise(value - previous)

    stepped = windowed.withColumn("_d", step(F.col("counter"), F.lag("counter").over(inside)))
    per_window = stepped.groupBy(*keys, "window_start").agg(
        F.sum("_d").alias("_inner"), F.min_by("counter", at).alias("_first"), F.max_by("counter", at).alias("_last"))
    series = Window.partitionBy(*keys).orderBy("window_start")
    entry = step(F.col("_first"), F.lag("_last").over(series))
    zero = F.lit(0)
    increase = (F.coalesce("_inner", zero) + F.coalesce(entry, zero)).cast("bigint")
    return per_window.withColumn("increase", increase).select(
        *keys, "window_start", "increase", (F.col("increase") / size_s).alias("rate"))


def sliding_rates(events: DataFrame, keys: list[str], size_s: int = WINDOW_S, step_s: int = STEP_S) -> DataFrame:
    """Events per second over a sliding window, batch form.

    Rows are counted per step first; only those counts are copied into the windows that cover them.
    """
    steps = events.groupBy(*keys, bucket_start("ts_us", step_s).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(size_s // step_s - 1)), lambda k: F.col("_t") - k * step_s)
    copied = steps.select(*keys, "_n", F.explode(starts).alias("window_start"))
    summed = copied.groupBy(*keys, "window_start").agg(F.sum("_n").alias("events"))
    return summed.withColumn("rate", F.col("events") / size_s)


def tumbling_counts(events: DataFrame, keys: list[str], size_s: int = WINDOW_S) -> DataFrame:
    counted = events.groupBy(*keys, bucket_start("ts_us", size_s).alias("window_start")).agg(F.count(F.lit(1)).alias("events"))
    return counted.withColumn("rate", F.col("events") / size_s)


def gauges(samples: DataFrame, keys: list[str], value: str = "size", size_s: int = GAUGE_S) -> DataFrame:
    """Latest sample per key and window."""
    return samples.groupBy(*keys, bucket_start("ts_us", size_s).alias("window_start")).agg(
        F.max_by(value, F.struct("ts_us", "event_id")).alias(value))


def page_deadlines(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Pages slower than the deadline become 'ocr_timeout' errors, which are not stored."""
    slow = F.col("seconds") > p.page_deadline_s
    return events.withColumn("timed_out", slow).withColumn("error", F.when(slow, "ocr_timeout"))


def stored_pages(events: DataFrame, p: Params = Params()) -> DataFrame:
    return page_deadlines(events, p).where("NOT timed_out").drop("timed_out", "error")
