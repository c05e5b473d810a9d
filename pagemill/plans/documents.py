"""Documents: expected pages, results, failed messages, roll-ups and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import texts
from pagemill.functions.numbers import rounded
from pagemill.operators import documents as D
from pagemill.operators.quantiles import positions
from pagemill.params import Params
from pagemill.plans import bindings as B
from pagemill.sources.messages import parse_messages

QUERIES, ORACLE = {}, {}
P = Params()


def stored(s, d):
    return D.latest_results(B.page_results(s, d))


def outcomes(s, d):
    failed = D.failed_pages(parse_messages(B.failed_messages(s, d)))
    return D.page_outcomes(B.documents_expected(s, d), stored(s, d), failed)


LATEST = """
latest AS (SELECT * FROM page_results QUALIFY row_number() OVER (PARTITION BY document_id, page_index ORDER BY ts_us DESC, result_id DESC) = 1)"""
NOTES = """
notes AS (SELECT * FROM parsed WHERE actor_name = 'process_page_task'
          QUALIFY row_number() OVER (PARTITION BY document_key, page_index ORDER BY position DESC) = 1)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_UNKNOWN = _quoted(texts.MISSING_UNKNOWN)
_TOLD = _quoted(texts.MISSING_FAILED.replace("%d", "{}").replace("%s", "{}"))
_SUMMARY_OK = _quoted(texts.PAGE_OK.replace("%d", "{}").replace("%s", "{}").replace("%.2f%%", "{:.2f}%"))
_SUMMARY_ERROR = _quoted(texts.PAGE_ERROR.replace("%d", "{}").replace("%s", "{}"))
_A, _B = texts.ERROR_PREFIXES
MESSAGE = f"""CASE WHEN bad = 0 THEN format({_quoted(texts.ALL_OK.replace('%d', '{}'))}, ok, total_pages)
                WHEN ok = 0 THEN format({_quoted(texts.ALL_FAILED.replace('%d', '{}'))}, bad, total_pages)
                ELSE format({_quoted(texts.PARTIAL.replace('%d', '{}'))}, ok, bad, total_pages) END"""
_EXPLAINED = f"""CASE WHEN contains(ERR, '{_A[0]}') THEN concat('{_A[1]}', ERR) WHEN contains(ERR, '{_B[0]}') THEN concat('{_B[1]}', ERR) ELSE ERR END"""
OUTCOMES = f"""
numbered AS (SELECT document_id, num_pages, unnest(range(num_pages)) AS page_index FROM documents_expected),
joined AS (SELECT n.document_id, n.page_index, n.page_index + 1 AS page_number, l.document_type, coalesce(l.confidence, 0) AS confidence,
    l.result_id IS NULL AS missing,
    CASE WHEN l.result_id IS NULL AND f.message_id IS NOT NULL THEN format({_TOLD}, f.retries, f.max_retries, f.message_id)
         WHEN l.result_id IS NULL THEN {_UNKNOWN}
         WHEN contains(l.error, '{_A[0]}') THEN concat('{_A[1]}', l.error) WHEN contains(l.error, '{_B[0]}') THEN concat('{_B[1]}', l.error)
         ELSE l.error END AS error
  FROM numbered n LEFT JOIN latest l ON l.document_id = n.document_id AND l.page_index = n.page_index
       LEFT JOIN notes f ON f.document_key = CAST(n.document_id AS VARCHAR) AND f.page_index = n.page_index),
outcomes AS (SELECT *, CASE WHEN error IS NOT NULL THEN format({_SUMMARY_ERROR}, page_number, error)
    ELSE format({_SUMMARY_OK}, page_number, coalesce(document_type, 'None'), confidence * 100) END AS summary FROM joined),
counted AS (SELECT d.document_id, coalesce(d.filename, concat('document_', d.document_id)) AS filename, d.num_pages AS total_pages,
    count(*) FILTER (WHERE o.page_number IS NOT NULL AND o.error IS NULL) AS ok, count(o.error) AS bad,
    count(*) FILTER (WHERE o.missing) AS gaps
  FROM documents_expected d LEFT JOIN outcomes o ON o.document_id = d.document_id GROUP BY 1, 2, 3),
reported AS (SELECT document_id, filename, CASE WHEN bad = 0 THEN 'success' WHEN ok = 0 THEN 'error' ELSE 'partial_success' END AS status,
    total_pages, ok AS successful_pages, bad AS failed_pages, gaps AS missing_count,
    CASE WHEN total_pages > 0 THEN round(CAST(ok AS DOUBLE) / total_pages * 100, 2) ELSE 0 END AS success_rate,
    {MESSAGE} AS message FROM counted)"""
_PARTS = (B.PAGE_RESULTS, B.DOCUMENTS_EXPECTED, B.FAILED_MESSAGES, LATEST, NOTES, OUTCOMES)

# J1, J2, F2, F3 (rows)
_OUTCOME = ["document_id", "page_number", "document_type", "confidence", "error", "missing", "summary"]
QUERIES["page_outcomes"] = lambda s, d: outcomes(s, d).select(*_OUTCOME)
ORACLE["page_outcomes"] = B.sql(f"SELECT {', '.join(_OUTCOME)} FROM outcomes", *_PARTS)

# A2, A18, F3 (message), J3
_REPORT = ["document_id", "filename", "status", "total_pages", "successful_pages", "failed_pages", "missing_count", "success_rate"]


def document_report(s, d):
    return D.document_results(outcomes(s, d), B.documents_expected(s, d)).select(*_REPORT, "message")


QUERIES["document_report"] = document_report
ORACLE["document_report"] = B.sql(f"SELECT {', '.join(_REPORT)}, message FROM reported", *_PARTS)
QUERIES["document_counts"] = lambda s, d: D.document_counts(outcomes(s, d), B.documents_expected(s, d))
ORACLE["document_counts"] = B.sql(f"SELECT {', '.join(_REPORT)} FROM reported", *_PARTS)


# J1 alone: gaps without explanations
def missing_pages(s, d):
    rows = D.page_outcomes(B.documents_expected(s, d), stored(s, d))
    return rows.where("missing").select("document_id", "page_number", "confidence", "error")


QUERIES["missing_pages"] = missing_pages
ORACLE["missing_pages"] = B.sql(f"""
SELECT n.document_id, n.page_index + 1 AS page_number, CAST(0 AS DOUBLE) AS confidence, {_UNKNOWN} AS error
FROM (SELECT document_id, unnest(range(num_pages)) AS page_index FROM documents_expected) n
WHERE NOT EXISTS (SELECT 1 FROM page_results r WHERE r.document_id = n.document_id AND r.page_index = n.page_index)""",
    B.PAGE_RESULTS, B.DOCUMENTS_EXPECTED)

# F2
QUERIES["explained_errors"] = lambda s, d: B.page_results(s, d).where("error IS NOT NULL").select(
    "result_id", texts.explained_error(F.col("error")).alias("error"))
ORACLE["explained_errors"] = B.sql(f"""
SELECT result_id, CASE WHEN contains(error, '{_A[0]}') THEN concat('{_A[1]}', error) WHEN contains(error, '{_B[0]}') THEN concat('{_B[1]}', error)
  ELSE error END AS error FROM page_results WHERE error IS NOT NULL""", B.PAGE_RESULTS)


# A18
def run_figures(s, d):
    spent = B.page_events(s, d).groupBy("document_id").agg(F.sum("seconds").alias("seconds"))
    counts = D.document_counts(outcomes(s, d), B.documents_expected(s, d))
    return counts.join(spent, "document_id", "left").select(
        "document_id", "success_rate", D.seconds_per_page(F.col("seconds"), F.col("total_pages")).alias("seconds_per_page"))


QUERIES["run_figures"] = run_figures
ORACLE["run_figures"] = B.sql("""
SELECT r.document_id, r.success_rate, round(s.seconds / r.total_pages, 3) AS seconds_per_page
FROM reported r JOIN (SELECT document_id, sum(seconds) AS seconds FROM page_events GROUP BY 1) s ON s.document_id = r.document_id""",
    *_PARTS, B.PAGE_EVENTS)

# J3
QUERIES["document_filenames"] = lambda s, d: D.with_filenames(
    B.page_results(s, d).select("document_id").distinct(), B.documents_expected(s, d).select("document_id", "filename")
).select("document_id", "filename")
ORACLE["document_filenames"] = B.sql(
    "SELECT document_id, coalesce(filename, concat('document_', document_id)) AS filename FROM documents_expected", B.DOCUMENTS_EXPECTED)

# W1
_STORED = ["document_id", "page_index", "result_id", "document_type", "confidence", "error"]
QUERIES["latest_results"] = lambda s, d: stored(s, d).select(*_STORED)
ORACLE["latest_results"] = B.sql(f"SELECT {', '.join(_STORED)} FROM latest", B.PAGE_RESULTS, LATEST)

# W2
QUERIES["page_positions"] = lambda s, d: positions(
    stored(s, d).select("document_id", "page_index"), [F.col("page_index")], ["document_id"], "index0").select(
    "document_id", "page_index", "index0", (F.col("index0") + 1).alias("page_number"))
ORACLE["page_positions"] = B.sql("""
SELECT document_id, page_index, row_number() OVER w - 1 AS index0, row_number() OVER w AS page_number
FROM latest WINDOW w AS (PARTITION BY document_id ORDER BY page_index)""", B.PAGE_RESULTS, LATEST)

# S6
QUERIES["page_fan_out"] = lambda s, d: D.named_pages(
    B.table(s, d, "documents").selectExpr("concat('in/doc', CAST(doc_id AS STRING), '.pdf') AS path", "n_chars div 400 AS num_pages")
).select("path", "total_pages", "page_index", "page_number", "page_name")
ORACLE["page_fan_out"] = """
SELECT path, total_pages, page_index, page_index + 1 AS page_number, concat('doc', doc_id, '_page', page_index + 1) AS page_name
FROM (SELECT doc_id, concat('in/doc', doc_id, '.pdf') AS path, n_chars // 400 AS total_pages, unnest(range(n_chars // 400)) AS page_index FROM documents)"""

# S7, U1
_BOTH = """
both_maps AS (SELECT coalesce(l.document_id, e.document_id) AS document_id, coalesce(l.page_index, e.page_index) AS page_index,
    CASE WHEN e.error IS NULL THEN l.text END AS first_line, e.error
  FROM map_lines l FULL JOIN map_errors e ON l.document_id = e.document_id AND l.page_index = e.page_index)"""
QUERIES["pages_from_maps"] = lambda s, d: D.pages_from_maps(B.page_maps(s, d)).select(
    "document_id", "page_index", F.get("lines", F.lit(0)).alias("first_line"), "error")
ORACLE["pages_from_maps"] = B.sql("SELECT document_id, page_index, first_line, error FROM both_maps", B.PAGE_MAPS, _BOTH)
QUERIES["documents_without_pages"] = lambda s, d: D.documents_without_pages(B.page_maps(s, d))
ORACLE["documents_without_pages"] = B.sql("""
SELECT conv_id AS document_id, 'no page data' AS problem FROM conversations GROUP BY conv_id
HAVING count(*) FILTER (WHERE (turn % 3 <> 0 OR turn % 4 = 0) AND conv_id % 9 <> 8) = 0""", B.PAGE_MAPS)
QUERIES["page_ids"] = lambda s, d: D.page_ids(B.page_maps(s, d))
ORACLE["page_ids"] = B.sql("SELECT document_id, page_index FROM map_lines UNION SELECT document_id, page_index FROM map_errors ORDER BY 1, 2", B.PAGE_MAPS)


# U2
def batch_output(s, d):
    results = B.page_results(s, d)
    good = results.where("error IS NULL").select("result_id", F.lit("success").alias("status"), "document_type", "confidence")
    bad = results.where("error IS NOT NULL").select("result_id", F.lit("error").alias("status"), F.lit(0.0).alias("confidence"), "error")
    return D.batch_output(good, bad)


QUERIES["batch_output"] = batch_output
ORACLE["batch_output"] = B.sql("""
SELECT result_id, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, CASE WHEN error IS NULL THEN document_type END AS document_type,
  CASE WHEN error IS NULL THEN confidence ELSE 0 END AS confidence, error FROM page_results""", B.PAGE_RESULTS)


# nested record in blocks: array shapes as text
def document_records(s, d):
    return D.document_blocks(outcomes(s, d)).select(
        "document_id", "block", "missing_list",
        F.array_join(F.transform("results_by_page", lambda r: F.concat(r["page_number"].cast("string"), F.lit(":"), F.coalesce(r["document_type"], F.lit("-")))), ",").alias("types"),
        rounded(F.aggregate("results_by_page", F.lit(0.0), lambda a, r: a + r["confidence"]), 4).alias("confidence_sum"),
        F.array_join("page_summary", "|").alias("page_summary"))


LISTED = f"""CASE WHEN bool_or(missing) THEN concat('{texts.MISSING_LIST}',
    string_agg(CAST(page_number AS VARCHAR), ', ' ORDER BY page_number) FILTER (WHERE missing)) ELSE '' END"""
QUERIES["document_records"] = document_records
ORACLE["document_records"] = B.sql(f"""
SELECT document_id, page_index // {D.BLOCK} AS block, {LISTED} AS missing_list,
  string_agg(concat(page_number, ':', coalesce(document_type, '-')), ',' ORDER BY page_number) AS types,
  round(sum(confidence ORDER BY page_number), 4) AS confidence_sum, string_agg(summary, '|' ORDER BY page_number) AS page_summary
FROM outcomes GROUP BY document_id, page_index // {D.BLOCK}""", *_PARTS)


# A2, J1: documents decided at completeness or at their deadline, by the time of each result
def _decided(s, d):
    return D.decided_results(B.timed_documents(s, d), B.timed_results(s, d))


_DEADLINE_S = P.document_deadline_s
DECIDED = f"""
starts AS (SELECT document_id, min(ts_us) AS first_us FROM timed_results GROUP BY 1),
reached AS (SELECT r.document_id, n.num_pages, first_us, page_index, min(r.ts_us) AS at_us
  FROM timed_results r JOIN starts USING (document_id) JOIN timed_documents n USING (document_id)
  WHERE r.ts_us <= first_us + {_DEADLINE_S * 1000000} AND page_index BETWEEN 0 AND n.num_pages - 1 GROUP BY ALL),
decided AS (SELECT document_id, num_pages, first_us, count(*) < num_pages AS late,
    CASE WHEN count(*) < num_pages THEN first_us + {_DEADLINE_S * 1000000} ELSE max(at_us) END AS decided_us FROM reached GROUP BY document_id, num_pages, first_us),
in_time AS (SELECT r.* FROM timed_results r JOIN decided USING (document_id) WHERE r.ts_us <= decided_us
  QUALIFY row_number() OVER (PARTITION BY document_id, page_index ORDER BY r.ts_us DESC, result_id DESC) = 1),
expected AS (SELECT document_id, num_pages, late, unnest(range(num_pages)) AS page_index FROM decided),
judged AS (SELECT e.document_id, e.page_index, e.page_index + 1 AS page_number, i.document_type, coalesce(i.confidence, 0) AS confidence,
    i.result_id IS NULL AS missing,
    CASE WHEN i.result_id IS NULL AND e.late THEN {_quoted(texts.MISSING_TIMEOUT.replace("%d", str(_DEADLINE_S)))}
         WHEN i.result_id IS NULL THEN {_UNKNOWN} ELSE {_EXPLAINED.replace("ERR", "i.error")} END AS error
  FROM expected e LEFT JOIN in_time i ON i.document_id = e.document_id AND i.page_index = e.page_index),
rolled AS (SELECT document_id, count(*) AS total_pages, count(*) FILTER (WHERE error IS NULL) AS ok, count(error) AS bad,
    count(*) FILTER (WHERE missing) AS gaps FROM judged GROUP BY 1),
records AS (SELECT document_id, total_pages, ok AS successful_pages, bad AS failed_pages, gaps AS missing_count, late AS timeout_reached,
    round((decided_us - first_us) / 1000000, 3) AS processing_time,
    CASE WHEN bad = 0 THEN 'success' WHEN ok = 0 THEN 'error' ELSE 'partial_success' END AS status,
    concat({MESSAGE}, CASE WHEN late THEN '{texts.DEADLINE_NOTE.replace("%d", str(_DEADLINE_S))}' ELSE '' END) AS message
  FROM rolled JOIN decided USING (document_id))"""
TIMED_PARTS = (B.TIMED, DECIDED)
RECORD = ["document_id", "total_pages", "successful_pages", "failed_pages", "missing_count", "timeout_reached", "processing_time", "status", "message"]


def documents_by_deadline(s, d):
    documents, results = _decided(s, d)
    return D.document_results(D.page_outcomes(documents, results), documents).select(*RECORD)


QUERIES["documents_by_deadline"] = documents_by_deadline
ORACLE["documents_by_deadline"] = B.sql(f"SELECT {', '.join(RECORD)} FROM records", *TIMED_PARTS)
_JUDGED = ["document_id", "page_number", "document_type", "confidence", "error", "missing"]
QUERIES["pages_by_deadline"] = lambda s, d: D.page_outcomes(*_decided(s, d)).select(*_JUDGED)
ORACLE["pages_by_deadline"] = B.sql(f"SELECT {', '.join(_JUDGED)} FROM judged", *TIMED_PARTS)
