"""Streaming jobs over the events table, drained and read back. They equal their batch SQL for any split of the table into
files and any order of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.numbers import rounded
from pagemill.operators.documents import BLOCK, latest_results
from pagemill.operators.monitoring import bucket_quantile
from pagemill.plans import bindings as B
from pagemill.plans import documents as D
from pagemill.plans import failures as M
from pagemill.plans import monitoring as Q
from pagemill.session import run_dir
from pagemill.sinks.current import CurrentTable
from pagemill.sources.streams import event_stream
from pagemill.streaming import documents as SD
from pagemill.streaming import rates as SR
from pagemill.streaming.retries import start_retries
from pagemill.streaming.tasks import task_states
from pagemill.streaming.runner import drain, drain_into, drain_to_end, newest, stream_session

QUERIES, ORACLE = {}, {}
# The table is a bounded source whose files come in any order, so the delay spans more than its history: no row is late.
ANY_ORDER = "3650 days"


def _events(s, d):
    return event_stream(stream_session(s), d)


def _monitor(s, d):
    return _events(s, d).selectExpr(*B._MONITOR_EXPRS, "ts", "ts_us")


# S10
QUERIES["stream_directory"] = lambda s, d: drain(s, "directory", _events(s, d).select("event_id", "user_id", "ts_us"), "append").drop("batch_id")
ORACLE["stream_directory"] = "SELECT event_id, user_id, epoch_us(ts) AS ts_us FROM events"


# T1
def stream_upserts(s, d):
    results = _events(s, d).selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in B._PAGE_RESULT_EXPRS], "ts", "ts_us")
    base = run_dir(s, "upserts")
    current = drain_into(s, CurrentTable(f"{base}/table", latest_results), SD.distinct_results(results, ANY_ORDER), f"{base}/checkpoint")
    return current.select(*D._STORED)


QUERIES["stream_upserts"] = stream_upserts
ORACLE["stream_upserts"] = D.ORACLE["latest_results"]


# T2, T3
def stream_fan_in(s, d):
    timed = _events(s, d).selectExpr(*B.TIMED_EXPRS, "ts_us div 1000 AS ts_us").withColumn("ts", F.timestamp_micros("ts_us"))
    results = timed.withColumn("ok", F.col("error").isNull()).select("document_id", "num_pages", "page_index", "ok", "result_id", "ts", "ts_us")
    emitted = drain_to_end(s, "fanin", results, lambda r: SD.fan_in(r, delay=ANY_ORDER))
    return emitted.select(*D.RECORD, "block", "missing_list")


QUERIES["stream_fan_in"] = stream_fan_in
ORACLE["stream_fan_in"] = B.sql(f"""
SELECT {', '.join(D.RECORD)}, block, missing_list
FROM records JOIN (SELECT document_id, page_index // {BLOCK} AS block, {D.LISTED} AS missing_list FROM judged GROUP BY ALL) USING (document_id)""",
    *D.TIMED_PARTS)


# T4
def stream_sliding_rates(s, d):
    written = drain(s, "sliding", SR.sliding_counts(_monitor(s, d), ["status", "doc_type"], delay=ANY_ORDER))
    keys = ["status", "doc_type", "window_start"]
    return newest(written, keys).select(*keys, "events", rounded(F.col("events") / 300, 9).alias("rate"))


QUERIES["stream_sliding_rates"] = stream_sliding_rates
ORACLE["stream_sliding_rates"] = Q.ORACLE["sliding_rates"]


# T5
def stream_quantiles(s, d):
    written = drain(s, "quantiles", SR.windowed_histograms(_monitor(s, d), ["status"], delay=ANY_ORDER))
    latest = newest(written, ["status", "window_start"])
    return latest.select("status", "window_start", "observations", rounded(bucket_quantile(F.col("cumulative"), 0.5)).alias("p50"),
                         rounded(bucket_quantile(F.col("cumulative"), 0.95)).alias("p95"))


QUERIES["stream_quantiles"] = stream_quantiles
ORACLE["stream_quantiles"] = Q.ORACLE["duration_quantiles_5min"]


# T6
def _tumbling(key, condition="true"):
    def run(s, d):
        written = drain(s, "tumbling", SR.tumbling_counts(_monitor(s, d).where(condition), [key], delay=ANY_ORDER))
        return newest(written, [key, "window_start"]).select(key, "window_start", "events", rounded(F.col("events") / 300, 9).alias("rate"))
    return run


QUERIES["stream_error_rates"] = _tumbling("error_type", "error_type IS NOT NULL")
ORACLE["stream_error_rates"] = Q.ORACLE["error_rates"]
QUERIES["stream_status_rates"] = _tumbling("status")
ORACLE["stream_status_rates"] = Q.ORACLE["status_rates"]


# T7
def stream_gauges(s, d):
    samples = _monitor(s, d).withColumnRenamed("counter", "size")
    return newest(drain(s, "gauges", SR.gauges(samples, ["queue_name"], delay=ANY_ORDER)), ["queue_name", "window_start"])


QUERIES["stream_gauges"] = stream_gauges
ORACLE["stream_gauges"] = Q.ORACLE["backlog_gauges"]


# T9
def stream_retries(s, d):
    raw = _events(s, d).where("event_type = 'error'").selectExpr("event_id AS position", f"{B._message('STRING', 'ts_us div 1000')} AS raw")
    base = run_dir(s, "retries")
    start_retries(raw, f"{base}/requeue", f"{base}/failed", f"{base}/checkpoint").awaitTermination()
    again, spent = s.read.parquet(f"{base}/requeue"), s.read.parquet(f"{base}/failed")
    return again.select("message_id", "retries", F.lit("requeued").alias("fate")).unionByName(
        spent.select("message_id", "retries", F.lit("failed").alias("fate")))


QUERIES["stream_retries"] = stream_retries
ORACLE["stream_retries"] = M.ORACLE["retry_split"]


# T10
def stream_task_states(s, d):
    exprs, _ = B._dual(B._TASK)
    events = _events(s, d).selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in exprs], "ts", "ts_us")
    return newest(drain_to_end(s, "tasks", events, lambda e: task_states(e, delay=ANY_ORDER), "update"), ["task_id"])


QUERIES["stream_task_states"] = stream_task_states
ORACLE["stream_task_states"] = M.ORACLE["task_states"]
