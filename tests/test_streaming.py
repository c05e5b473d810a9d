"""Streams fed file by file: duplicates, late rows, completeness, deadline, restart, and the events table as a folder."""

import datetime as dt
import os
import time

import pytest
from compare import connect, differences
from conftest import SF
from pyspark.sql import functions as F

from pagemill.operators.documents import latest_results
from pagemill.operators.monitoring import sliding_rates
from pagemill.params import Params
from pagemill.plans import streams
from pagemill.sources.streams import event_stream, read_stream
from pagemill.streaming import documents as SD
from pagemill.streaming import rates as SR
from pagemill.streaming.runner import newest, start, stream_session
from pagemill.streaming.tasks import task_states

SCHEMA = "document_id bigint, num_pages bigint, page_index bigint, ok boolean, result_id bigint, ts timestamp, ts_us bigint"
T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, rows, when):
    """One parquet file of (document, pages, page, ok, id, second); file times order the stream."""
    full = [(d, n, p, ok, i, T0 + dt.timedelta(seconds=s), 0) for d, n, p, ok, i, s in rows]
    df = spark.createDataFrame(full, SCHEMA).withColumn("ts_us", F.unix_micros("ts")).coalesce(1)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df.write.mode("append").parquet(str(folder))
    for name in set(os.listdir(folder)) - before:
        os.utime(f"{folder}/{name}", (when, when))


def drained(spark, build, folder, out, mode, reduce=None):
    session = stream_session(spark, 2)
    stream = read_stream(session, str(folder), SCHEMA, files_per_batch=1)
    start(build(stream), f"{out}/rows", f"{out}/checkpoint", mode, reduce).awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def test_fan_in(spark, tmp_path):
    src, out, now = tmp_path / "in", tmp_path / "out", time.time() - 1000
    # 1 completes over two files with a repeated page; 2 misses page 1; its late result changes nothing.
    put(spark, src, [(1, 2, 0, False, 1, 0), (2, 2, 0, True, 2, 0)], now)
    put(spark, src, [(1, 2, 0, True, 3, 20), (1, 2, 1, True, 4, 30), (1, 2, 1, True, 4, 30)], now + 10)
    put(spark, src, [(9, 1, 0, True, 5, 2000)], now + 20)
    put(spark, src, [(2, 2, 1, True, 6, 1990), (9, 1, 0, False, 7, 2001)], now + 30)

    def run():
        return drained(spark, lambda s: SD.fan_in(s, Params(), "1 minute"), src, out, "append")

    got = {r["document_id"]: r for r in run().collect()}
    assert sorted(got) == [1, 2]  # the watermark has not passed the decision of 9
    assert (got[1]["successful_pages"], got[1]["failed_pages"], got[1]["timeout_reached"], got[1]["status"], got[1]["processing_time"]) == (2, 0, False, "success", 30)
    assert (got[2]["successful_pages"], got[2]["missing_pages"], got[2]["timeout_reached"], got[2]["status"]) == (1, [2], True, "partial_success")
    # restart from the checkpoint: only new files are read, finished documents stay silent
    put(spark, src, [(1, 2, 0, False, 8, 2100), (7, 1, 0, False, 9, 2100)], now + 40)
    put(spark, src, [(6, 1, 0, False, 10, 3000)], now + 50)
    again = run()
    assert sorted(r["document_id"] for r in again.collect()) == [1, 2, 7, 9]
    assert again.where("document_id = 7").first()["status"] == "error"
    assert again.where("document_id = 9").first()["status"] == "success"  # the write after completion does not count


def test_expired_documents_start_anew(spark, tmp_path):
    src, out, now = tmp_path / "in", tmp_path / "out", time.time() - 1000
    day = 86400
    put(spark, src, [(1, 1, 0, True, 1, 0)], now)
    put(spark, src, [(8, 1, 0, True, 2, 3 * day)], now + 10)
    put(spark, src, [(1, 1, 0, False, 3, 3 * day + 10)], now + 20)
    put(spark, src, [(8, 1, 0, True, 4, 5 * day)], now + 30)
    rows = drained(spark, lambda s: SD.fan_in(s, Params(), "1 minute"), src, out, "append").where("document_id = 1").collect()
    assert sorted(r["status"] for r in rows) == ["error", "success"]


TASK = "task_id bigint, event_id bigint, status string, result string, error string, ts timestamp, ts_us bigint"


def test_finished_tasks_are_forgotten(spark, tmp_path):
    """Events come out of order; a task is gone a day after its end, so a later update finds none, and a null id is left out."""
    src, out, now, day = tmp_path / "in", tmp_path / "out", time.time() - 1000, 86400
    files = [
        [(1, 2, "completed", "r", None, 50), (None, 9, "pending", None, None, 5)], [(1, 1, "pending", None, None, 10), (2, 3, "pending", None, None, 60)],
        [(3, 4, "pending", None, None, 3 * day)], [(2, 6, "processing", None, None, 3 * day + 9)],
        [(1, 5, "failed", None, "e", 3 * day + 10), (3, 7, "failed", None, "e", 9 * day)],
    ]
    for n, rows in enumerate(files):
        df = spark.createDataFrame([(*r[:5], T0 + dt.timedelta(seconds=r[5]), 0) for r in rows], TASK).withColumn("ts_us", F.unix_micros("ts"))
        df.coalesce(1).write.parquet(f"{src}/{n}")
        for name in os.listdir(f"{src}/{n}"):
            os.utime(f"{src}/{n}/{name}", (now + n, now + n))
    stream = read_stream(stream_session(spark, 2), f"{src}/*", TASK, files_per_batch=1)
    start(task_states(stream, Params(), "1 minute"), f"{out}/rows", f"{out}/checkpoint", "update").awaitTermination()
    got = {r["task_id"]: r for r in newest(spark.read.parquet(f"{out}/rows"), ["task_id"]).collect()}
    assert (got[1]["status"], got[1]["completed_us"] - got[1]["created_us"], got[1]["error"]) == ("completed", 40_000_000, None)
    assert (got[2]["status"], got[3]["status"]) == ("processing", "pending")


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events table as n part files in no order of time, with its SQL view."""
    made = {}

    def split(parts):
        if parts not in made:
            folder = tmp_path_factory.mktemp(f"parts{parts}")
            spark.read.parquet(f"{SF}/events.parquet").repartition(parts, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
            made[parts] = str(folder)
        return made[parts]

    return split


@pytest.mark.parametrize("parts", [3, 24])
@pytest.mark.parametrize("name", sorted(streams.QUERIES))
def test_any_split_into_files_gives_the_same_rows(spark, split_events, name, parts):
    folder = split_events(parts)
    problem, rows = differences(spark, connect(SF), folder, streams.QUERIES[name], streams.ORACLE[name])
    assert problem is None, problem
    assert rows > 0


def test_upserts_equal_the_batch_twin(spark, tmp_path):
    src, out, now = tmp_path / "in", tmp_path / "out", time.time() - 1000
    rows = [(d, 9, p, (d + p + v) % 2 == 0, d * 100 + p * 10 + v, 60 * v + d) for d in range(4) for p in range(3) for v in range(3)]
    put(spark, src, rows[::2] + rows[:5], now)
    put(spark, src, rows[1::2] + rows[:9], now + 10)
    keep = ["document_id", "page_index", "ok", "result_id", "ts_us"]

    def latest(df):
        return latest_results(df.select(*keep))

    written = drained(spark, SD.distinct_results, src, out, "append", latest)
    twin = latest(spark.read.schema(SCHEMA).parquet(str(src)))
    assert written.count() < 2 * len(rows)
    assert {tuple(r) for r in latest(written).select(*keep).collect()} == {tuple(r) for r in twin.select(*keep).collect()}


def test_sliding_counts_equal_the_batch_twin(spark, tmp_path):
    src, out, now = tmp_path / "in", tmp_path / "out", time.time() - 1000
    put(spark, src, [(1, 1, 0, i % 2 == 0, i, i * 7) for i in range(40)], now)
    put(spark, src, [(1, 1, 0, i % 2 == 0, 100 + i, 100 + i * 5) for i in range(40)], now + 10)
    written = drained(spark, lambda s: SR.sliding_counts(s, ["ok"], "1 minute", "10 seconds"), src, out, "update")
    got = {tuple(r) for r in newest(written, ["ok", "window_start"]).select("ok", "window_start", "events").collect()}
    twin = sliding_rates(spark.read.schema(SCHEMA).parquet(str(src)), ["ok"], 60, 10)
    assert got == {tuple(r) for r in twin.select("ok", "window_start", "events").collect()}


@pytest.mark.parametrize("parts", [1, 3])
def test_events_as_a_folder_of_parts(spark, tmp_path, parts):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(parts).write.parquet(str(tmp_path / "events.parquet"))
    out = tmp_path / "out"
    start(event_stream(stream_session(spark, 2), str(tmp_path), 2).select("event_id"), f"{out}/rows", f"{out}/checkpoint", "append").awaitTermination()
    assert spark.read.parquet(f"{out}/rows").select("event_id").distinct().count() == events.count()


def test_the_callers_session_is_untouched(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    stream_session(spark, 3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
