"""Labels, split, models, evaluation, scoring."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagemill.functions.numbers import softmax
from pagemill.operators import boosting
from pagemill.operators import evaluation as E
from pagemill.operators import scoring as S
from pagemill.operators import training as T
from pagemill.params import Params
from pagemill.plans import bindings as B
from pagemill.plans import registry


def test_label_order(spark):
    files = spark.createDataFrame([("A_1.json", None), ("doc1.json", None), ("B_2_x.json", "Json"), ("C_3.json", "Json")], "file_name string, json_type string")
    mapping = spark.createDataFrame([("C_3.json", "Mapped"), ("zz", "No")], "file_name string, mapped_type string")
    got = {r["file_name"]: r["document_type"] for r in T.resolve_labels(files, mapping).collect()}
    assert got == {"A_1.json": "A", "B_2_x.json": "Json", "C_3.json": "Mapped"}


def test_scores(spark):
    classes = spark.createDataFrame([(0, "Facture"), (1, "Attestation_CEE")], "class_index bigint, class_name string")
    df = spark.createDataFrame([(1, [.9, .1]), (2, [.2, .8]), (3, [.5, .5]), (4, [.1, .2, .7])], "i int, probabilities array<double>")
    rows = {r["i"]: (r["document_type"], r["confidence"]) for r in S.score(df, classes).collect()}
    assert rows == {1: ("Facture", .9), 2: ("Attestation_CEE", .8), 3: (None, .5), 4: ("2", .7)}
    fixed = S.fixed_class(spark.createDataFrame([(1.0,)], "prediction double")).first()
    assert (fixed["class_index"], fixed["confidence"]) == (1, 1.0)
    soft = spark.createDataFrame([([1000., 1001.],)], "v array<double>").select(softmax(F.col("v"))).first()[0]
    assert abs(sum(soft) - 1) < 1e-12


def test_split_is_stratified_and_exact(spark):
    rows = spark.range(1000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 700, 0).when(F.col("id") < 990, 1).otherwise(2).alias("label"))
    split = T.stratified_split(rows)
    assert split.count() == 1000
    tests = {r["label"]: r["n"] for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert tests == {0: 140, 1: 58, 2: 2}
    again = T.stratified_split(rows.repartition(7)).where("is_test").select("vec_id")
    assert again.exceptAll(split.where("is_test").select("vec_id")).count() == 0
    other = T.stratified_split(rows, p=Params(seed=7)).where("is_test").select("vec_id")
    assert other.exceptAll(again).count() > 0


def test_split_needs_a_test_row_per_class(spark):
    rows = spark.range(4).select(F.col("id").alias("vec_id"), F.col("id").alias("label"))
    with pytest.raises(Exception, match="smaller than the number of classes"):
        T.stratified_split(rows).collect()


def test_report(spark):
    pairs = [(0, 0)] * 4 + [(0, 1)] + [(1, 1)] * 3 + [(1, 0)] * 2
    df = spark.createDataFrame(pairs, "label bigint, prediction bigint")
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "never")], "class_index bigint, class_name string")
    report = {r["class_name"]: r for r in E.class_report(df, classes).collect()}
    assert report["a"]["precision"] == pytest.approx(4 / 6) and report["a"]["recall"] == pytest.approx(.8) and report["a"]["support"] == 5
    assert (report["never"]["precision"], report["never"]["f1"], report["never"]["support"]) == (0, 0, 0)
    assert E.accuracy(df).first()["accuracy"] == .7
    cells = {(r["label"], r["prediction"]): r["n"] for r in E.confusion(df).collect()}
    assert cells == {(0, 0): 4, (0, 1): 1, (1, 0): 2, (1, 1): 3} and sum(cells.values()) == len(pairs)
    few = df.where("label = prediction")
    assert E.confusion(few).count() == 2 and {(r["label"], r["prediction"]): r["n"] for r in E.confusion(few, fill=True).collect()} == {(0, 0): 4, (0, 1): 0, (1, 0): 0, (1, 1): 3}
    document = E.report_document(df, classes, "now", "m", "d").first()
    assert [c["class_name"] for c in document["classes"]] == ["a", "b", "never"] and len(document["matrix"]) == 4 and document["accuracy"] == .7
    assert document["feature_importance"] is None and document["test_rows"] == 10
    avg = {r["average"]: r for r in E.averages(E.class_report(df, classes)).collect()}
    assert avg["weighted avg"]["recall"] == pytest.approx(.7)
    assert avg["macro avg"]["recall"] == pytest.approx((.8 + .6) / 3)


@pytest.fixture(scope="module")
def train_rows(spark):
    base = B.table(spark, "/root/testdata/sf0.001", "embeddings").where("label < 3")
    # Two clear directions per class on top of the noise, so that every model must learn them.
    shaped = base.select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_name"), F.concat(
        F.slice("embedding", 1, 4).cast("array<double>"), F.array(F.col("label") * 2.0, 1.0 - F.col("label"))).alias("vector"))
    return T.features(shaped).cache()


@pytest.mark.parametrize("kind,settings", [("logistic_regression", {"maxIter": 20}), ("random_forest", {"numTrees": 5})])
def test_models(spark, train_rows, tmp_path, kind, settings):
    model = T.train(train_rows, kind, **settings)
    T.save_model(model, str(tmp_path / "m"))
    loaded = T.load_model(str(tmp_path / "m"))
    classes = T.model_classes(loaded, spark)
    assert [r["class_name"] for r in classes.collect()] == ["c0", "c1", "c2"]
    scored = S.score_with_model(train_rows, loaded, classes, Params(class_min_confidence=0.0))
    hits = scored.where("document_type = class_name").count()
    assert hits / train_rows.count() > .95


def test_boosted_query_takes_all_rounds(spark, monkeypatch):
    rounds = []

    def fit(rows, *_, s=boosting.Settings(), **__):
        rounds.append(s)
        raise StopIteration

    monkeypatch.setattr(boosting, "fit", fit)
    with pytest.raises(StopIteration):
        registry.queries()["model_boosted"](spark, "/root/testdata/sf0.001")
    assert rounds == [boosting.Settings()] and rounds[0].rounds == 100


def test_unknown_model():
    with pytest.raises(ValueError):
        T.classifier("perceptron")


def test_hash_is_stable(spark):
    value = spark.range(1).select(T.hash_key(42, "id")).first()[0]
    assert value == int(hashlib.md5(b"42:0").hexdigest()[:12], 16) % 2147483647


def test_split_has_no_stride(spark):
    rows = spark.range(20_000).selectExpr("id", "'a' AS class_name", "0 AS label")
    chosen = sorted(r["id"] for r in T.stratified_split(rows, key="id").where("is_test").collect())
    gaps = {b - a for a, b in zip(chosen, chosen[1:])}
    assert len(chosen) == 4000 and len(gaps) > 15
