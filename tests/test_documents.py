"""Documents, failed messages, recovery and tasks on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import texts
from pagemill.operators import documents as D
from pagemill.operators import failures as M
from pagemill.operators import recovery as R
from pagemill.operators import tasks as T

RESULT = "result_id bigint, document_id bigint, page_index bigint, document_type string, confidence double, error string, ts_us bigint"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(1, 2, "a.pdf"), (2, 3, None), (3, 0, "c.pdf"), (4, 1, "d.pdf")], "document_id bigint, num_pages bigint, filename string")


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([
        (1, 1, 0, "Facture", .95, None, 10), (2, 1, 1, None, .5, None, 10), (3, 1, 0, "Contrat", .80, None, 5),
        (4, 2, 0, None, .0, "OCR failed: x", 10), (5, 2, 1, "Facture", .9, None, 10), (6, 4, 0, None, 0., "Image not found: 3", 1),
    ], RESULT)


def message(i, doc, page, actor="process_page_task", extra=""):
    return (i, '{"message_id":"m%d","actor_name":"%s","args":["u",%d,"%s"],"queue_name":"q"%s}' % (i, actor, page, doc, extra))


def test_report(spark, documents, results):
    raw = spark.createDataFrame([message(1, 2, 2, extra=',"options":{"retries":3,"max_retries":3}'), message(2, 2, 2, "other"), (3, "junk{")], "position bigint, raw string")
    failed = D.failed_pages(M.parse_messages(raw))
    outcomes = D.page_outcomes(documents, D.latest_results(results), failed)
    full = {r["document_id"]: r for r in D.document_results(outcomes, documents).collect()}
    lists = {r["document_id"]: r for r in D.document_blocks(outcomes).collect()}
    assert [full[i]["status"] for i in (1, 2, 3, 4)] == ["success", "partial_success", "success", "error"]
    assert lists[1]["page_summary"] == ["Page 1: OK - Facture (confiance: 95.00%)", "Page 2: OK - None (confiance: 50.00%)"]
    assert full[1]["message"] == "Toutes les pages ont été traitées avec succès (2/2)"
    assert lists[2]["missing_pages"] == [3] and full[2]["success_rate"] == 33.33
    assert full[2]["message"] == "Traitement partiel: 1 page(s) réussie(s), 2 page(s) échouée(s) sur 3 total"
    assert lists[2]["missing_list"] == ". Pages manquantes: 3" and lists[1]["missing_list"] == "" and 3 not in lists
    assert "OCR Timeout ou Erreur: OCR failed: x" in lists[2]["page_summary"][0]
    assert "3/3 tentatives" in lists[2]["results_by_page"][2]["error"] and "m1" in lists[2]["results_by_page"][2]["error"]
    assert full[2]["filename"] == "document_2"
    assert full[3]["total_pages"] == 0 and full[3]["success_rate"] == 0
    assert full[4]["message"] == "Toutes les pages ont échoué (1/1)"
    assert lists[4]["results_by_page"][0]["error"] == "Image non trouvée: Image not found: 3"


def test_deadline_text(spark, documents, results):
    late = documents.withColumn("timeout_reached", F.lit(True))
    outcomes = D.page_outcomes(late, D.latest_results(results))
    r = D.document_results(outcomes, late).where("document_id = 2").first()
    assert r["message"].endswith(" [TIMEOUT: Le timeout global de 300s a été atteint]")
    assert "Timeout global (300s)" in outcomes.where("document_id = 2 AND missing").first()["error"]


def test_decision_by_time(spark):
    """Complete in time, complete too late, a write after completion, no result, no page, a page out of range."""
    s = 1_000_000
    documents = spark.createDataFrame([(1, 2, "a"), (2, 2, "b"), (3, 1, "c"), (4, 0, "d"), (5, 1, "e")], "document_id bigint, num_pages bigint, filename string")
    rows = [(1, 1, 0, 0), (2, 1, 1, 300 * s), (3, 2, 0, 0), (4, 2, 1, 300 * s + 1), (5, 1, 0, 299 * s), (6, 5, 0, 5 * s), (7, 5, 0, 6 * s), (8, 5, 7, 5 * s)]
    results = spark.createDataFrame([(i, d, n, f"t{i}", .9, None, t) for i, d, n, t in rows], RESULT)
    judged, counted = D.decided_results(documents, results)
    got = {r["document_id"]: (r["timeout_reached"], r["processing_time"]) for r in judged.collect()}
    assert got == {1: (False, 300.0), 2: (True, 300.0), 3: (True, None), 4: (False, None), 5: (False, 0.0)}
    assert sorted(r["document_type"] for r in counted.collect()) == ["t2", "t3", "t5", "t6"]


def test_whole_results_are_sorted_once_for_the_decision(spark):
    """They are joined by page, in the order the newest of a page is taken in."""
    documents = spark.createDataFrame([(1, 2, "a")], "document_id bigint, num_pages bigint, filename string")
    results = spark.range(9).selectExpr(
        "id AS result_id", "id % 3 AS document_id", "id AS page_index", "'t' AS document_type", "0.9D AS confidence", "CAST(NULL AS STRING) AS error", "id AS ts_us")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D.decided_results(documents, results)[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortAggregate" in plan and not re.search(r"SortAggregate\(.*\n\W*(\(\d+\) )?Sort \[", plan)


def test_decisions_of_random_results(spark):
    rng, s = random.Random(5), 1_000_000
    sizes = {d: rng.randrange(4) for d in range(40)}
    rows = [(i, rng.randrange(40), rng.choice([0, 0, 1, 1, 2, 3, -1, None]), f"t{i}", .9, None, rng.choice([None, *range(0, 450 * s, 25 * s)])) for i in range(300)]
    documents = spark.createDataFrame([(d, n, "f") for d, n in sizes.items()], "document_id bigint, num_pages bigint, filename string")
    judged, counted = D.decided_results(documents, spark.createDataFrame(rows, RESULT).repartition(3))
    late, newest = {}, {}
    for d, n in sizes.items():
        mine = [(r[6], r[0], r[2]) for r in rows if r[1] == d and r[6] is not None]
        first = min((r[0] for r in mine), default=None)
        timely = [r for r in mine if r[2] is not None and 0 <= r[2] < n and r[0] <= first + 300 * s]
        reached = {k: min(r[0] for r in timely if r[2] == k) for k in {r[2] for r in timely}}
        late[d] = len(reached) < n
        end = first if not reached and not late[d] else None if first is None else first + 300 * s if late[d] else max(reached.values())
        for r in sorted(r for r in timely if r[0] <= end):
            newest[d, r[2]] = r[1]
    assert {r["document_id"]: r["timeout_reached"] for r in judged.collect()} == late
    assert {(r["document_id"], r["page_index"]): r["result_id"] for r in counted.collect()} == newest


@pytest.mark.parametrize("pages", [3, 20_001])
def test_records_look_alike_at_any_size(spark, pages):
    """Every third page is missing; counts, message and blocks have one form for short and long documents."""
    document = spark.createDataFrame([(1, pages, "a.pdf")], "document_id bigint, num_pages bigint, filename string")
    results = spark.range(pages).where("id % 3 < 2").selectExpr(
        "id AS result_id", "1L AS document_id", "id AS page_index", "'Facture' AS document_type", "0.9D AS confidence", "CAST(NULL AS STRING) AS error", "id AS ts_us")
    outcomes = D.page_outcomes(document, results)
    r = D.document_results(outcomes, document).first()
    gaps = pages // 3
    assert (r["missing_count"], r["status"], r["timeout_reached"], r["processing_time"]) == (gaps, "partial_success", False, None)
    assert r["message"] == f"Traitement partiel: {pages - gaps} page(s) réussie(s), {gaps} page(s) échouée(s) sur {pages} total"
    blocks = sorted(D.document_blocks(outcomes).collect(), key=lambda b: b["block"])
    assert [b["block"] for b in blocks] == list(range(-(-pages // D.BLOCK)))
    assert [n for b in blocks for n in b["missing_pages"]] == list(range(3, pages + 1, 3))
    assert sum(len(b["results_by_page"]) for b in blocks) == sum(len(b["page_summary"]) for b in blocks) == pages


def test_page_numbers_cross_block_borders(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 4)
    docs = spark.createDataFrame([(1, 9), (2, 4), (3, 0)], "document_id bigint, num_pages bigint")
    got = sorted((r["document_id"], r["page_index"]) for r in D.page_numbers(docs).collect())
    assert got == [(1, i) for i in range(9)] + [(2, i) for i in range(4)]


def test_maps(spark):
    df = spark.createDataFrame([(1, {0: ["a"], 1: ["b"]}, {1: "bad", 2: "worse"}), (2, {}, None)],
                               "document_id bigint, lines map<bigint,array<string>>, errors map<bigint,string>")
    rows = {r["page_index"]: (r["lines"], r["error"]) for r in D.pages_from_maps(df).collect()}
    assert rows == {0: (["a"], None), 1: (None, "bad"), 2: (None, "worse")}
    assert [r["document_id"] for r in D.documents_without_pages(df).collect()] == [2]
    assert [r["page_index"] for r in D.page_ids(df).collect()] == [0, 1, 2]


def test_status_rules(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1)], "ok int, bad int")
    got = [r[0] for r in df.select(texts.document_status(F.col("ok"), F.col("bad"))).collect()]
    assert got == ["success", "success", "error", "partial_success"]


def test_message_parsing(spark):
    raw = spark.createDataFrame([(0, "not json{"), (1, "{}"), (2, "[1]"), (3, '{"retries":2,"message_timestamp":5}'), (4, '{"options":{"retries":1}}')], "position bigint, raw string")
    rows = {r["position"]: r for r in M.parse_messages(raw).collect()}
    assert set(rows) == {1, 3, 4}
    assert (rows[1]["retries"], rows[1]["args"], rows[1]["kwargs"]) == (0, [], {})
    assert (rows[3]["retries"], rows[3]["sent_ms"], rows[4]["retries"]) == (2, 5, 1)
    assert {r["actor_name"]: r["messages"] for r in M.by_actor(M.parse_messages(raw)).collect()} == {"unknown": 3}
    assert M.parse_messages(raw, keep_malformed=True).count() == 5


def test_removal_replay_and_budget(spark):
    raw = spark.createDataFrame([(0, "not json{"), message(1, 1, 1, extra=',"options":{"retries":3,"max_retries":3}'), message(2, 1, 2)], "position bigint, raw string")
    ids = spark.createDataFrame([("m1",), ("zz",)], "message_id string")
    assert sorted(r["position"] for r in M.without_messages(raw, ids).collect()) == [0, 2]
    r = M.replayed(raw, ids).first()
    assert (r["message_id"], r["options"]["retries"], r["options"]["max_retries"], r["retries"]) == ("m1", 0, 3, 0)
    again, spent = M.retry_split(M.parse_messages(raw))
    assert [(r["message_id"], r["retries"]) for r in again.collect()] == [("m2", 1)]
    assert [r["message_id"] for r in spent.collect()] == ["m1"]
    empty, count = M.cleared(raw)
    assert empty.count() == 0 and count.first()["removed"] == 3
    assert [tuple(r) for r in M.backlog(M.parse_messages(raw.limit(0))).collect()] == [("default", 0)]
    assert [tuple(r) for r in M.backlog(M.parse_messages(raw)).collect()] == [("q", 2)]


def test_recovery(spark):
    hour = 3600 * 1_000_000
    pages = spark.createDataFrame([(1, 0, 0, True), (1, 0, 5, True), (1, 1, 3, False), (2, 0, 2 * hour, True), (3, 0, 0, False), (4, 0, 0, True), (5, 0, 0, True)],
                                  "document_id bigint, page_index bigint, ts_us bigint, has_result boolean")
    finals = spark.createDataFrame([(4,)], "document_id bigint")
    queued = spark.createDataFrame([('{"actor_name":"finalize_document_task","args":["5"]}',), ('{"actor_name":"x","args":["1"]}',), ("junk",)], "raw string")
    stale = R.stale_documents(pages, finals, queued, 2 * hour)
    names = spark.createDataFrame([(9, "z")], "document_id bigint, filename string")
    assert [tuple(r) for r in R.restart_requests(stale, names).collect()] == [("finalize_document_task", 1, "document_1", 2)]


def test_tasks(spark):
    rows = [(1, 1, "processing", None, None, 1), (1, 2, "pending", None, None, 2), (1, 3, "processing", None, None, 3), (1, 4, "processing", None, None, 4),
            (1, 5, "failed", None, "e1", 5), (1, 6, "completed", "r", None, 6), (2, 7, "completed", "x", None, 7)]
    events = spark.createDataFrame(rows, "task_id bigint, event_id bigint, status string, result string, error string, ts_us bigint")
    got = T.task_states(events).collect()
    assert [tuple(r) for r in got] == [(1, "completed", 2, 3, 6, "r", "e1")]
    day = 24 * 3600 * 1_000_000
    assert T.expired_tasks(T.task_states(events), day + 7).first()["expired"]
    assert not T.expired_tasks(T.task_states(events), day + 6).first()["expired"]
    kept, gone = T.retained(T.expired_tasks(T.task_states(events), day + 7))
    assert (kept.count(), gone.count()) == (0, 1)
    files = spark.createDataFrame([("a.png", 0), ("a.meta", 0), ("b.png", 10**10)], "path string, modified_us bigint")
    assert [r["path"] for r in T.retained(T.expired_files(files, 3600 * 10**6 + 1))[1].collect()] == ["a.png"]
