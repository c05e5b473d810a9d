"""Text lines and vectors on literal rows."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import lines as L
from pagemill.operators import vectors as V
from pagemill.params import Params

SCHEMA = "doc_id bigint, page_index bigint, line_no bigint, text string, confidence double, x1 double, y1 double, x2 double, y2 double"
ROWS = [(1, 0, 0, "a", .95, 100., 200., 500., 250.), (1, 0, 1, "b", .88, 100., 300., 400., 350.),
        (1, 0, 2, "c", .50, 100., 400., 500., 450.), (1, 0, 3, "d", .92, 100., 500., 600., 550.)]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def vectors_of(df):
    return [round(v, 5) for v in df.first()["vector"]]


def test_confidence_filter(spark, lines):
    assert L.confident_lines(lines).count() == 3
    assert L.confident_lines(lines, Params(line_min_confidence=0.4)).count() == 4
    assert L.confident_lines(lines, Params(line_min_confidence=0.0)).count() == 4
    missing = spark.createDataFrame([(1, 0, 0, "a", None, 0., 0., 1., 1.)], SCHEMA)
    assert L.confident_lines(missing).count() == 0


def test_positions_on_a_given_page_size(spark):
    one = spark.createDataFrame([(1, 0, 0, "a", .9, 100., 200., 500., 300.)], SCHEMA)
    r = L.positions(one, L.page_extents(one, width=1000, height=2000)).first()
    assert [round(r[f"{b}_share"], 6) for b in L.BOX] == [.1, .1, .5, .15]


def test_extent_inference(spark, lines):
    r = L.page_extents(L.confident_lines(lines)).first()
    assert (r["page_width"], r["page_height"]) == (660, 605)
    flat = spark.createDataFrame([(1, 0, 0, "a", .9, 0., 0., 0., 0.)], SCHEMA)
    r = L.page_extents(flat).first()
    assert (r["page_width"], r["page_height"]) == (2000, 2000)


def test_zero_extent_gives_zero_positions(spark):
    one = spark.createDataFrame([(1, 0, 0, "a", .9, 1., 1., 1., 1.)], SCHEMA)
    r = L.positions(one, L.page_extents(one, width=0, height=0)).first()
    assert [r[f"{b}_share"] for b in L.BOX] == [0, 0, 0, 0]


def test_boxes(spark):
    rows = [(1, [1., 2., 3., 4.], None), (2, None, [[5., 1.], [9., 2.], [8., 7.], [4., 6.]]), (3, None, [[5., 1.], [9.]]),
            (4, None, None), (5, [1., 2.], None), (6, None, [])]
    boxes = {r["i"]: r["rect"] for r in L.canonical_boxes(spark.createDataFrame(rows, "i int, box array<double>, corners array<array<double>>")).collect()}
    assert boxes == {1: [1, 2, 3, 4], 2: [4, 1, 9, 7], 3: [0, 0, 0, 0], 4: None, 5: [0, 0, 0, 0], 6: [0, 0, 0, 0]}


def test_checked_lines(spark):
    rows = [("a", .5, [1., 2., 3., 4.], 0.), ("a", 1.5, [1., 2., 3., 4.], 0.), ("a", .5, [1., 2.], 0.), ("a", .5, [1., 2., 3., 4.], -1.), (None, .5, [1., 2., 3., 4.], 0.)]
    good, bad = L.checked_lines(spark.createDataFrame(rows, "text string, confidence double, rect array<double>, processing_time double"))
    assert good.count() == 1
    assert {r["problem"] for r in bad.collect()} == {"confidence_range", "box_shape", "negative_time", "text_missing"}


@pytest.mark.parametrize("dim", [1, 64, 65, 384])
def test_every_width_is_treated_alike(spark, dim):
    rows = [(1, [1.0] * dim, .5), (1, [None] * dim, .5), (2, [3.0] * dim, 0.0)]
    df = spark.createDataFrame(rows, "k int, vector array<double>, confidence double")
    found = {r["k"]: list(r["vector"]) for r in V.aggregate_vectors(df, ["k"], dim).collect()}
    assert found == {1: [.5] * dim, 2: [None] * dim}


def test_vector_aggregation(spark):
    df = spark.createDataFrame([(1, [1., 2., 3.], .9), (1, [4., 5., 6.], .8), (1, [7., 8., 9.], .7)], "k int, vector array<double>, confidence double")
    assert vectors_of(V.aggregate_vectors(df, ["k"], 3)) == [3.75, 4.75, 5.75]
    assert vectors_of(V.aggregate_vectors(df, ["k"], 3, weight=None)) == [4, 5, 6]
    assert vectors_of(V.aggregate_vectors(df, ["k"], 3, "mean")) == [4, 5, 6]
    assert vectors_of(V.aggregate_vectors(df, ["k"], 3, "max")) == [7, 8, 9]
    assert vectors_of(V.aggregate_vectors(df, ["k"], 3, "sum")) == [12, 15, 18]
    with pytest.raises(ValueError):
        V.aggregate_vectors(df, ["k"], 3, "median")


def test_long_form_agrees(spark):
    df = spark.createDataFrame([(k, [float(k * i % 7), float(i)], .5 + i % 5 / 10) for k in range(5) for i in range(20)], "k int, vector array<double>, confidence double")
    short = {(r["k"], i): round(v, 5) for r in V.aggregate_vectors(df, ["k"], 2).collect() for i, v in enumerate(r["vector"])}
    long = {(r["k"], r["dim"]): round(r["value"], 5) for r in V.explode_aggregate(df, ["k"]).collect()}
    assert short == long


def test_no_usable_line_gives_the_zero_vector(spark, lines):
    weak = lines.withColumns({"confidence": F.lit(0.1), "semantic": F.array(F.lit(1.0), F.lit(2.0))})
    pages = spark.createDataFrame([(1, 0)], "doc_id bigint, page_index bigint")
    assert V.document_vectors(weak, pages, 2).first()["vector"] == [0.0] * 6


def test_page_vector_equals_the_line_form(spark, lines):
    rich = lines.withColumn("semantic", F.array(F.col("x1") / 7, F.col("y2") / 3))
    pages = spark.createDataFrame([(1, 0)], "doc_id bigint, page_index bigint")
    kept = L.confident_lines(rich)
    stepwise = V.aggregate_vectors(V.line_features(L.positions(kept, L.page_extents(kept))), L.PAGE, 6)
    assert vectors_of(V.document_vectors(rich, pages, 2)) == vectors_of(stepwise)


def test_encoders_give_unit_vectors(spark, lines):
    def load():
        return lambda texts: [[float(len(t)), 2.0] for t in texts]

    for encoded in (V.hashed_encoder(lines, 8), V.encode_with(lines, load)):
        for r in encoded.collect():
            assert abs(sum(v * v for v in r["semantic"]) - 1) < 1e-9
