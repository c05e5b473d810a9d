"""Counters, histograms, quantiles, rates and gauges."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.numbers import rounded
from pagemill.operators import monitoring as M
from pagemill.params import DOCUMENT_BOUNDS, PAGE_BOUNDS
from pagemill.plans import bindings as B
from pagemill.plans import documents as D

QUERIES, ORACLE = {}, {}

# A15
QUERIES["page_outcome_counts"] = lambda s, d: M.page_outcome_counts(B.page_events(s, d))
ORACLE["page_outcome_counts"] = B.sql("SELECT status, doc_type, count(*) AS pages FROM page_events GROUP BY 1, 2", B.PAGE_EVENTS)
QUERIES["error_counts"] = lambda s, d: M.error_counts(B.page_events(s, d))
ORACLE["error_counts"] = B.sql("SELECT error_type, count(*) AS errors FROM page_events WHERE error_type IS NOT NULL GROUP BY 1", B.PAGE_EVENTS)
QUERIES["document_status_counts"] = lambda s, d: M.document_status_counts(D.QUERIES["document_counts"](s, d))
ORACLE["document_status_counts"] = B.sql("SELECT status, count(*) AS documents FROM reported GROUP BY 1", *D._PARTS)


# A16
def _cumulative(bounds):
    return "[" + ", ".join(f"count(*) FILTER (WHERE seconds <= {b}::DOUBLE)" for b in bounds) + ", count(*)]"


def _histogram_sql(bounds, key):
    labels = "[" + ", ".join(f"'{b}'" for b in bounds) + ", '+Inf']"
    return f"""SELECT {key}, observations, round(total, 4) AS total, unnest({labels}) AS le, unnest(c) AS cumulative
    FROM (SELECT {key}, count(*) AS observations, sum(seconds) AS total, {_cumulative(bounds)} AS c FROM page_events GROUP BY 1)"""


def _histogram(bounds, key):
    def run(s, d):
        arrays = M.histogram_arrays(B.page_events(s, d), [key], "seconds", bounds)
        return M.histogram_rows(arrays, [key], bounds).withColumn("total", rounded(F.col("total"), 4))
    return run


QUERIES["page_duration_histogram"] = _histogram(PAGE_BOUNDS, "status")
ORACLE["page_duration_histogram"] = B.sql(_histogram_sql(PAGE_BOUNDS, "status"), B.PAGE_EVENTS)
QUERIES["document_duration_histogram"] = _histogram(DOCUMENT_BOUNDS, "queue_name")
ORACLE["document_duration_histogram"] = B.sql(_histogram_sql(DOCUMENT_BOUNDS, "queue_name"), B.PAGE_EVENTS)

# W4, T5
_EDGES = "[0.0::DOUBLE, " + ", ".join(f"{b}::DOUBLE" for b in PAGE_BOUNDS) + "]"
_N = len(PAGE_BOUNDS)


def _quantile(share):
    index = f"list_position(list_transform(c, lambda v: v >= c[{_N + 1}] * {share}::DOUBLE), true)"
    below = f"CASE WHEN {index} = 1 THEN 0 ELSE c[{index} - 1] END"
    return (f"round(CASE WHEN {index} = {_N + 1} THEN {PAGE_BOUNDS[-1]}::DOUBLE ELSE e[{index}] + (e[{index} + 1] - e[{index}])"
            f" * (c[{_N + 1}] * {share}::DOUBLE - {below}) / (c[{index}] - {below}) END, 6)")


def quantiles_sql(size_s, keys="status", source="page_events"):
    return f"""SELECT {keys}, window_start, c[{_N + 1}] AS observations, {_quantile(0.5)} AS p50, {_quantile(0.95)} AS p95
FROM (SELECT {keys}, ts_us // {size_s * 1000000} * {size_s} AS window_start, {_cumulative(PAGE_BOUNDS)} AS c, {_EDGES} AS e FROM {source} GROUP BY 1, 2)"""


def _quantiles(size_s):
    def run(s, d):
        found = M.windowed_quantiles(B.page_events(s, d), ["status"], size_s=size_s)
        return found.select("status", "window_start", "observations", rounded(F.col("p50")).alias("p50"), rounded(F.col("p95")).alias("p95"))
    return run


QUERIES["duration_quantiles_5min"] = _quantiles(300)
ORACLE["duration_quantiles_5min"] = B.sql(quantiles_sql(300), B.PAGE_EVENTS)
QUERIES["duration_quantiles_daily"] = _quantiles(86400)
ORACLE["duration_quantiles_daily"] = B.sql(quantiles_sql(86400), B.PAGE_EVENTS)


# W3
def _rates(size_s):
    return lambda s, d: M.counter_rates(B.page_events(s, d), ["series"], size_s).select(
        "series", "window_start", "increase", rounded(F.col("rate"), 9).alias("rate"))


def _rates_sql(size_s):
    return B.sql(f"""
SELECT series, window_start, CAST(coalesce(sum(step), 0) AS BIGINT) AS increase, round(coalesce(sum(step), 0) / {size_s}, 9) AS rate
FROM (SELECT series, ts_us // {size_s * 1000000} * {size_s} AS window_start, CASE WHEN counter < prev THEN counter ELSE counter - prev END AS step
      FROM (SELECT *, lag(counter) OVER (PARTITION BY series ORDER BY ts_us, event_id) AS prev FROM page_events)) GROUP BY 1, 2""", B.PAGE_EVENTS)


QUERIES["counter_rates_5min"] = _rates(300)
ORACLE["counter_rates_5min"] = _rates_sql(300)
QUERIES["counter_rates_hourly"] = _rates(3600)
ORACLE["counter_rates_hourly"] = _rates_sql(3600)

# T4 (batch)
QUERIES["sliding_rates"] = lambda s, d: M.sliding_rates(B.page_events(s, d), ["status", "doc_type"]).select(
    "status", "doc_type", "window_start", "events", rounded(F.col("rate"), 9).alias("rate"))
SLIDING = """
SELECT status, doc_type, window_start, count(*) AS events, round(count(*) / 300, 9) AS rate
FROM (SELECT status, doc_type, ts_us // 10000000 * 10 - 10 * unnest(range(30)) AS window_start FROM page_events) GROUP BY 1, 2, 3"""
ORACLE["sliding_rates"] = B.sql(SLIDING, B.PAGE_EVENTS)


# T6 (batch)
def tumbling_sql(key, condition="true"):
    return f"""SELECT {key}, ts_us // 300000000 * 300 AS window_start, count(*) AS events, round(count(*) / 300, 9) AS rate
FROM page_events WHERE {condition} GROUP BY 1, 2"""


QUERIES["error_rates"] = lambda s, d: M.tumbling_counts(B.page_events(s, d).where("error_type IS NOT NULL"), ["error_type"]).select(
    "error_type", "window_start", "events", rounded(F.col("rate"), 9).alias("rate"))
ORACLE["error_rates"] = B.sql(tumbling_sql("error_type", "error_type IS NOT NULL"), B.PAGE_EVENTS)
QUERIES["status_rates"] = lambda s, d: M.tumbling_counts(B.page_events(s, d), ["status"]).select(
    "status", "window_start", "events", rounded(F.col("rate"), 9).alias("rate"))
ORACLE["status_rates"] = B.sql(tumbling_sql("status"), B.PAGE_EVENTS)

# T7 (batch)
GAUGES = """SELECT queue_name, ts_us // 10000000 * 10 AS window_start, max_by(counter, ts_us) AS size FROM page_events GROUP BY 1, 2"""
QUERIES["backlog_gauges"] = lambda s, d: M.gauges(B.page_events(s, d).withColumnRenamed("counter", "size"), ["queue_name"])
ORACLE["backlog_gauges"] = B.sql(GAUGES, B.PAGE_EVENTS)

# T11
QUERIES["page_deadlines"] = lambda s, d: M.page_deadlines(B.page_events(s, d)).select("event_id", "timed_out", "error")
ORACLE["page_deadlines"] = B.sql(
    "SELECT event_id, seconds > 30 AS timed_out, CASE WHEN seconds > 30 THEN 'ocr_timeout' END AS error FROM page_events", B.PAGE_EVENTS)


def deadline_gaps(s, d):
    """Expected pages whose every attempt missed the deadline (or that were never tried): not stored, so missing."""
    from pagemill.operators.documents import page_numbers

    kept = M.stored_pages(B.page_events(s, d)).select("document_id", "page_index").distinct()
    return page_numbers(B.documents_expected(s, d)).join(kept, ["document_id", "page_index"], "left_anti").select("document_id", "page_index")


QUERIES["deadline_gaps"] = deadline_gaps
ORACLE["deadline_gaps"] = B.sql("""
SELECT document_id, page_index FROM (SELECT document_id, unnest(range(num_pages)) AS page_index FROM documents_expected) n
WHERE NOT EXISTS (SELECT 1 FROM page_events e WHERE e.document_id = n.document_id AND e.page_index = n.page_index AND e.seconds <= 30)""",
    B.PAGE_EVENTS, B.DOCUMENTS_EXPECTED)
