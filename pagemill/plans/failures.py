"""Failed messages, retries, backlog, retention, orphaned documents, tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import failures as M
from pagemill.operators import recovery as R
from pagemill.operators import tasks as T
from pagemill.params import Params
from pagemill.plans import bindings as B
from pagemill.sinks.tables import expiring, readable

QUERIES, ORACLE = {}, {}
P = Params()
AS_OF = B.AS_OF_US


def parsed(s, d):
    return M.parse_messages(B.failed_messages(s, d))


# S8, F8
_FIELDS = ["position", "message_id", "actor_name", "queue_name", "retries", "max_retries", "sent_ms"]
QUERIES["messages_parsed"] = lambda s, d: parsed(s, d).select(
    *_FIELDS, F.get("args", F.lit(1)).cast("bigint").alias("page_index"), F.get("args", F.lit(2)).alias("document_key"))
ORACLE["messages_parsed"] = B.sql(f"SELECT {', '.join(_FIELDS)}, page_index, document_key FROM parsed", B.FAILED_MESSAGES)

# A7
QUERIES["messages_by_actor"] = lambda s, d: M.by_actor(parsed(s, d))
ORACLE["messages_by_actor"] = B.sql("SELECT coalesce(actor_name, 'unknown') AS actor_name, count(*) AS messages FROM parsed GROUP BY 1", B.FAILED_MESSAGES)
QUERIES["message_statistics"] = lambda s, d: M.message_statistics(parsed(s, d))
ORACLE["message_statistics"] = B.sql(
    "SELECT count(*) AS total_messages, min(sent_ms) AS oldest_ms, max(sent_ms) AS newest_ms FROM parsed", B.FAILED_MESSAGES)

# O3
QUERIES["first_messages"] = lambda s, d: M.first_messages(parsed(s, d)).select(*_FIELDS)
ORACLE["first_messages"] = B.sql(f"SELECT {', '.join(_FIELDS)} FROM parsed ORDER BY position LIMIT 100", B.FAILED_MESSAGES)


# U3: every message whose retry counter is spent is replayed and so leaves the store
def _spent(s, d):
    return parsed(s, d).where("retries >= 2").select("message_id")


QUERIES["message_details"] = lambda s, d: M.message_details(parsed(s, d), _spent(s, d)).select(*_FIELDS)
ORACLE["message_details"] = B.sql(f"SELECT {', '.join(_FIELDS)} FROM parsed WHERE retries >= 2", B.FAILED_MESSAGES)
QUERIES["messages_kept"] = lambda s, d: M.without_messages(B.failed_messages(s, d), _spent(s, d))
ORACLE["messages_kept"] = B.sql("""
SELECT position, raw FROM failed_messages WHERE position NOT IN (SELECT position FROM parsed WHERE retries >= 2)""", B.FAILED_MESSAGES)
QUERIES["messages_replayed"] = lambda s, d: M.replayed(B.failed_messages(s, d), _spent(s, d)).select(
    "message_id", "actor_name", "queue_name", F.col("options.retries").alias("retries"), F.col("options.max_retries").alias("max_retries"))
ORACLE["messages_replayed"] = B.sql(
    "SELECT message_id, actor_name, queue_name, CAST(0 AS BIGINT) AS retries, max_retries FROM parsed WHERE retries >= 2", B.FAILED_MESSAGES)
QUERIES["messages_cleared"] = lambda s, d: M.cleared(B.failed_messages(s, d))[1]
ORACLE["messages_cleared"] = B.sql("SELECT count(*) AS removed FROM failed_messages", B.FAILED_MESSAGES)


# T9
def retry_split(s, d):
    again, spent = M.retry_split(parsed(s, d))
    return again.select("message_id", "retries", F.lit("requeued").alias("fate")).unionByName(
        spent.select("message_id", "retries", F.lit("failed").alias("fate")))


QUERIES["retry_split"] = retry_split
ORACLE["retry_split"] = B.sql("""
SELECT message_id, CASE WHEN retries >= 3 THEN retries ELSE retries + 1 END AS retries,
  CASE WHEN retries >= 3 THEN 'failed' ELSE 'requeued' END AS fate FROM parsed""", B.FAILED_MESSAGES)

# A17
QUERIES["backlog"] = lambda s, d: M.backlog(parsed(s, d))
ORACLE["backlog"] = B.sql("SELECT queue_name, count(*) AS size FROM parsed GROUP BY 1", B.FAILED_MESSAGES)

# K5
QUERIES["live_results"] = lambda s, d: readable(expiring(B.page_results(s, d), P.result_ttl_s), AS_OF).select("result_id", "document_id", "expires_us")
ORACLE["live_results"] = B.sql(f"""
SELECT result_id, document_id, ts_us + 86400000000 AS expires_us FROM page_results WHERE ts_us + 86400000000 > {AS_OF}""", B.PAGE_RESULTS)
QUERIES["live_messages"] = lambda s, d: M.live(
    parsed(s, d).withColumn("sent_us", F.col("sent_ms") * 1000), AS_OF, P.failed_ttl_s, "sent_us").select("message_id")
ORACLE["live_messages"] = B.sql(f"SELECT message_id FROM parsed WHERE sent_ms * 1000 + 604800000000 > {AS_OF}", B.FAILED_MESSAGES)

# A14
AGES = f"""
distinct_pages AS (SELECT document_id, page_index, max(CASE WHEN has_result THEN ts_us END) AS newest FROM known_pages GROUP BY 1, 2),
ages AS (SELECT document_id, count(*) AS num_pages, count(newest) AS pages_with_results, max(newest) AS latest_us,
    CAST({AS_OF} - max(newest) AS DOUBLE) / 1000000 AS age_seconds FROM distinct_pages GROUP BY 1 HAVING count(newest) > 0)"""
_AGE = ["document_id", "num_pages", "pages_with_results", "latest_us"]
QUERIES["document_ages"] = lambda s, d: R.document_ages(B.known_pages(s, d), AS_OF).select(*_AGE, "age_seconds")
ORACLE["document_ages"] = B.sql(f"SELECT {', '.join(_AGE)}, age_seconds FROM ages", B.KNOWN_PAGES, AGES)

# J4
QUERIES["unfinished_documents"] = lambda s, d: R.unfinished(
    B.documents_expected(s, d).select("document_id"), B.final_results(s, d), B.queued_messages(s, d))
ORACLE["unfinished_documents"] = B.sql(
    "SELECT document_id FROM documents_expected WHERE document_id % 4 <> 0 AND document_id % 7 <> 0", B.DOCUMENTS_EXPECTED)


# T8
def restart_requests(s, d):
    stale = R.stale_documents(B.known_pages(s, d), B.final_results(s, d), B.queued_messages(s, d), AS_OF)
    return R.restart_requests(stale, B.documents_expected(s, d))


QUERIES["restart_requests"] = restart_requests
ORACLE["restart_requests"] = B.sql("""
SELECT 'finalize_document_task' AS actor_name, a.document_id, coalesce(d.filename, concat('document_', a.document_id)) AS filename, a.num_pages
FROM ages a JOIN documents_expected d ON d.document_id = a.document_id
WHERE a.age_seconds >= 3600 AND a.document_id % 4 <> 0 AND a.document_id % 7 <> 0""", B.KNOWN_PAGES, AGES, B.DOCUMENTS_EXPECTED)

# T10
STATES = """
created AS (SELECT task_id, min(ts_us) AS c FROM task_events WHERE status = 'pending' GROUP BY 1),
known_events AS (SELECT e.*, c.c FROM task_events e JOIN created c ON c.task_id = e.task_id WHERE e.ts_us >= c.c),
states AS (SELECT task_id, max_by(status, ts_us) AS status, min(ts_us) AS created_us,
    min(ts_us) FILTER (WHERE status = 'processing') AS started_us, max(ts_us) FILTER (WHERE status IN ('completed', 'failed')) AS completed_us,
    max_by(result, ts_us) FILTER (WHERE result IS NOT NULL) AS result, max_by(error, ts_us) FILTER (WHERE error IS NOT NULL) AS error
  FROM known_events GROUP BY 1)"""
QUERIES["task_states"] = lambda s, d: T.task_states(B.task_events(s, d))
ORACLE["task_states"] = B.sql("SELECT * FROM states", B.TASK_EVENTS, STATES)

# K6
QUERIES["task_retention"] = lambda s, d: T.expired_tasks(T.task_states(B.task_events(s, d)), AS_OF).select("task_id", "status", "completed_us", "expired")
ORACLE["task_retention"] = B.sql(f"""
SELECT task_id, status, completed_us, coalesce(status IN ('completed', 'failed') AND completed_us < {AS_OF - 86400 * 1000000}, false) AS expired
FROM states""", B.TASK_EVENTS, STATES)
QUERIES["file_retention"] = lambda s, d: T.expired_files(B.files(s, d), AS_OF).select("page_id", "path", "modified_us", "expired")
ORACLE["file_retention"] = B.sql(f"SELECT page_id, path, modified_us, modified_us < {AS_OF - 3600 * 1000000} AS expired FROM files", B.FILES)


# F4
def task_times(s, d):
    instant = F.timestamp_micros("ts_us")
    return B.task_events(s, d).select(
        "event_id", F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"), F.expr("ts_us div 1000").alias("epoch_ms"),
        (F.col("ts_us") / 1_000_000).alias("epoch_s"), (F.lit(AS_OF / 1e6) - F.col("ts_us") / 1_000_000).alias("age"),
        (F.col("ts_us") < F.lit(AS_OF - P.task_retention_s * 1_000_000)).alias("before_cutoff"))


QUERIES["task_times"] = lambda s, d: task_times(s, d).withColumn("age", F.round("age", 3))
ORACLE["task_times"] = B.sql(f"""
SELECT event_id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') AS iso, ts_us // 1000 AS epoch_ms, ts_us / 1000000 AS epoch_s,
  round({AS_OF // 1000000}::DOUBLE - ts_us / 1000000, 3) AS age, ts_us < {AS_OF - 86400 * 1000000} AS before_cutoff FROM task_events""", B.TASK_EVENTS)
