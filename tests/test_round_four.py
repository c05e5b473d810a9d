"""One small test for each finding of round 3 that was right."""

from pyspark.sql import Row

from pagemill.llm.simhash import TASK_EDGES, dealt, stars
from pagemill.operators import evaluation as E
from pagemill.sinks import tables as K
from pagemill.streaming.documents import DocumentFanIn
from pagemill.streaming.tasks import TaskLife


def test_long_report_holds_the_whole_matrix(spark):
    df = spark.createDataFrame([(0, 0)] * 4 + [(1, 1)] * 3, "label bigint, prediction bigint")
    classes = spark.createDataFrame([(0, "a"), (1, "b")], "class_index bigint, class_name string")
    cells = {(r["name"], r["metric"]): r["value"] for r in E.evaluation_report(df, classes).where("section = 'matrix'").collect()}
    assert cells == {("0", "0"): 4, ("0", "1"): 0, ("1", "0"): 0, ("1", "1"): 3}


def test_records_are_compressed_and_read_once(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS k", "'in' AS input_path", "'out' AS processed_path", "'SCAN' AS capture_type", "0.5D AS white_fraction", "1D AS processing_time")
    K.write_page_records(rows, str(tmp_path / "r"), ["k"], "preprocessing")
    files = list((tmp_path / "r").rglob("part-*"))
    plain = rows.count() * len(K.page_records(rows, ["k"], "preprocessing").first()["record"])
    assert files and all(f.name.endswith(".json.gz") for f in files) and sum(f.stat().st_size for f in files) * 5 < plain
    back = K.read_page_records(spark, str(tmp_path / "r"), "k bigint")
    assert back.columns == ["k", "record", "kind"]
    found = back.selectExpr("k", "kind", "variant_get(record, '$.capture_info.white_percentage', 'double') AS w")
    assert found.exceptAll(rows.selectExpr("k", "'preprocessing'", "0.5D")).isEmpty() and found.count() == 3000


def test_few_edges_stay_in_few_tasks(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = stars(spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6)], "a long, b long"))
        assert found.rdd.getNumPartitions() == 1
        assert {(r["node"], r["root"]) for r in found.collect()} == {(2, 1), (3, 1), (9, 1), (6, 5)}
        assert dealt(found, 50 * TASK_EDGES, "node").rdd.getNumPartitions() == found.rdd.getNumPartitions()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


class _Held:
    """A state, in memory, that counts how often it is asked."""

    def __init__(self, calls):
        self.calls, self.value, self.rows, self.timers = calls, None, [], set()

    def getValueState(self, *_):
        return _Held(self.calls)

    getListState = getValueState

    def __getattr__(self, name):
        def run(*args):
            self.calls.append(name)
            if name == "get":
                return self.value if self.value is not None else iter(self.rows) if self.rows else None
            if name == "update":
                self.value = args[0]
            elif name == "appendList":
                self.rows += args[0]
        return run


def test_a_key_asks_its_state_four_times_a_batch():
    calls = []
    task, row = TaskLife(60), Row(ts_us=5_000, event_id=1, status="pending", result=None, error=None)
    task.init(_Held(calls))
    assert list(task.handleInputRows((1,), iter([row, row]), None)) == [] and sorted(calls) == ["appendList", "get", "registerTimer", "update"]
    assert task.task.value[0] == 5 and task.waiting.rows == [(5_000, 1, "pending", None, None)] * 2
    calls.clear()
    fan = DocumentFanIn()
    fan.init(_Held(calls))
    page = Row(num_pages=1, page_index=0, ts_us=5_000, result_id=1, ok=True)
    assert list(fan.handleInputRows((1,), iter([page]), None)) == [] and sorted(calls) == ["appendList", "get", "registerTimer", "update"]
