"""Plans and hot keys: no cross joins, no forced broadcasts, no Python in batch plans, whole results under skew."""

import ast
import re
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagemill.operators import documents as D
from pagemill.operators import geometry as G
from pagemill.operators import monitoring as M
from pagemill.operators import training as T
from pagemill.operators import vectors as V
from pagemill.plans import registry

BATCH = [n for n in registry.oracles() if not n.startswith("stream_")]
SOURCE = Path(__file__).resolve().parents[1] / "pagemill"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(BATCH))
def test_plan_shape(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)
    python = r"BatchEvalPython|MapInPandas|FlatMapGroups" if name == "model_encoded_lines" else r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups"
    assert not re.search(python, text)  # the model hook is Python


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.queries()["messages_by_actor"](spark, SF))
    assert "EqualTo(event_type,error)" in text
    text = plan(registry.queries()["flag_statistics"](spark, SF))
    assert "l_shipdate" not in text and "l_extendedprice" not in text


def test_library_has_no_driver_side_rows():
    banned = {"collect", "toPandas", "toLocalIterator", "localCheckpoint", "crossJoin", "broadcast", "take", "foreach"}
    # the corpus operators read fits, counts and partition edges of a stated bound; take is also a method of batches
    bounded = {"collect", "broadcast", "take"}
    # a model's parameters: class list, bin edges, one best split for a leaf and block, nodes
    models = {"boosting.py", "models.py"}
    for path in SOURCE.rglob("*.py"):
        here = banned - bounded if path.parent.name == "llm" else banned - {"collect"} if path.name in models else banned
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                assert node.func.attr not in here, f"{path.name}: {node.func.attr}"


@pytest.fixture(scope="module")
def hot(spark):
    """30,000 rows, two thirds of them on one key."""
    return spark.range(30000).select(
        "id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50 + 2).cast("bigint").alias("document_id"), (F.col("id") % 11).cast("double").alias("v"))




def test_hot_document_results_are_whole(spark, hot):
    documents = spark.createDataFrame([(1, 9000, "hot.pdf"), (2, 5, None)], "document_id bigint, num_pages bigint, filename string")
    results = hot.select(
        F.col("id").alias("result_id"), "document_id", (F.col("id") % 9973).alias("page_index"), F.lit("Facture").alias("document_type"),
        F.lit(.9).alias("confidence"), F.lit(None).cast("string").alias("error"), F.col("id").alias("ts_us"))
    outcomes = D.page_outcomes(documents, D.latest_results(results))
    assert outcomes.where("document_id = 1").count() == 9000
    counts = D.document_counts(outcomes, documents).where("document_id = 1").first()
    want = results.where("document_id = 1 AND page_index < 9000").select("page_index").distinct().count()
    assert (counts["successful_pages"], counts["missing_count"]) == (want, 9000 - want)


def test_hot_class_split_is_exact(spark, hot):
    split = T.stratified_split(hot.select(F.col("id").alias("vec_id"), F.when(F.col("document_id") == 1, 1).otherwise(0).alias("label")))
    got = {r["label"]: r["n"] for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 2000, 1: 4000}


def test_hot_page_vector(spark, hot):
    lines = hot.select(F.col("document_id").alias("doc_id"), F.lit(0).cast("bigint").alias("page_index"), F.lit(.9).alias("confidence"), F.array("v").alias("semantic"),
                       F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"), F.lit(10.0).alias("x2"), F.lit(10.0).alias("y2"))
    pages = lines.select("doc_id", "page_index").distinct()
    got = V.document_vectors(lines, pages, 1).where("doc_id = 1").first()["vector"][0]
    assert got == pytest.approx(hot.where("document_id = 1").agg(F.avg("v")).first()[0], rel=1e-6)


def test_hot_page_skew(spark):
    angles = spark.range(20000).select(F.lit(1).alias("page_key"), (F.col("id") % 7 + 87).cast("double").alias("theta"))
    r = G.skew_estimates(angles).first()
    assert r["skew_angle"] == 0 and r["lines"] == 20000 and r["skew_confidence"] == pytest.approx(3 / 7, abs=1e-3)


def test_hot_series_rate(spark):
    samples = spark.range(20000).select(F.lit("s").alias("series"), F.col("id").alias("event_id"), (F.col("id") * 1_000_000).alias("ts_us"), (F.col("id") % 700).alias("counter"))
    total = M.counter_rates(samples, ["series"]).agg(F.sum("increase")).first()[0]
    values = [i % 700 for i in range(20000)]
    assert total == sum(b if b < a else b - a for a, b in zip(values, values[1:]))
