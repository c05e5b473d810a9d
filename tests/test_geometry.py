"""Geometry, capture type and replay on literal rows."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.functions import quads
from pagemill.functions.frames import once
from pagemill.operators import capture as C
from pagemill.operators import geometry as G
from pagemill.operators import transforms as X
from pagemill.params import Params

SQUARE = [[500., 100.], [100., 120.], [520., 900.], [90., 880.]]


def quad_of(spark, points):
    df = spark.createDataFrame([(points,)], "corners array<array<double>>")
    return once(quads.corner_indices(quads.four_points(df)), {"quad": quads.ordered()}).first()["quad"]


def test_quad_order(spark):
    assert quad_of(spark, SQUARE) == [[100, 120], [500, 100], [520, 900], [90, 880]]
    assert sorted(quad_of(spark, SQUARE)) == sorted(SQUARE)
    assert quad_of(spark, SQUARE[:3]) is None
    # ties: first index for top-left, the later one of equal x for top-right
    assert quad_of(spark, [[0., 10.], [10., 0.], [10., 10.], [0., 0.]]) == [[0, 0], [10, 0], [10, 10], [0, 10]]


@pytest.mark.parametrize("raw,want", [(350, 270), (45, 0), (46, 90), (-90, 270), (135, 90), (226, 270), (720, 0), (225, 180)])
def test_right_angles(spark, raw, want):
    r = G.normalise_orientation(spark.createDataFrame([(raw, 1.7)], "raw_angle int, raw_confidence double")).first()
    assert (r["orientation_angle"], r["orientation_confidence"], r["needs_rotation"]) == (want, 1.0, want != 0)


def test_scores(spark):
    df = spark.createDataFrame([([.1, .6, .2, .1],), ([2., 0., 5., 1.],), ([0., 0., 0., 0.],), ([1., 2.],)], "scores array<double>")
    rows = G.orientation_from_scores(df).collect()
    assert [(r["angle"], r["processed"]) for r in rows] == [(90, True), (180, True), (0, True), (0, False)]
    assert round(rows[0]["confidence"], 6) == .6 and rows[2]["confidence"] == 0 and rows[3]["confidence"] == 1


PAGE_SCHEMA = "name string, corners array<array<double>>, capture_type string, width int, height int"


def crop(spark, corners, capture="PHOTO", p=Params()):
    return G.crop_decisions(spark.createDataFrame([("p", corners, capture, 1000, 1000)], PAGE_SCHEMA), p).first()


def test_crop_cascade(spark):
    good = [[200., 200.], [800., 200.], [800., 800.], [200., 800.]]
    assert crop(spark, good, p=Params(crop_enabled=False))["crop_status"] == "skipped"
    assert crop(spark, good, "SCAN")["crop_status"] == "skipped_scan"
    assert crop(spark, good, "SCAN", Params(skip_crop_if_scan=False))["crop_status"] == "cropped"
    assert crop(spark, None)["crop_status"] == "no_detection"
    assert crop(spark, [])["crop_status"] == "no_detection"
    assert crop(spark, good[:3])["crop_status"] == "invalid_geometry"
    assert crop(spark, [[1.], [2.], [3.], [4.]])["crop_status"] == "error"
    assert crop(spark, good + [[100., 500.]])["crop_status"] == "error"
    assert crop(spark, [[0., 0.], [999., 0.], [999., 999.], [0., 999.]])["crop_status"] == "already_cropped"
    assert crop(spark, [[20., 200.], [800., 200.], [800., 800.], [20., 800.]])["crop_status"] == "rejected_overcrop"
    r = crop(spark, good)
    assert (r["crop_status"], r["area_ratio"], r["output_size"]["width"], r["output_size"]["height"]) == ("cropped", .36, 600, 600)
    assert r["margins"].asDict() == {"top": 20, "bottom": 20, "left": 20, "right": 20}
    assert r["source_points"] == good
    relative = crop(spark, [[x / 1000, y / 1000] for x, y in good])
    assert relative["crop_status"] == "cropped" and relative["area_ratio"] == pytest.approx(.36)
    assert crop(spark, None)["area_ratio"] == 1.0


def test_deskew_states(spark):
    df = spark.createDataFrame([(.05, .9), (.3, .9), (2., .1), (-2., .9)], "skew_angle double, skew_confidence double")
    assert [r["deskew_status"] for r in G.deskew_decisions(df).collect()] == ["skipped", "angle_too_small", "low_confidence", "success"]
    off = Params(deskew_enabled=False)
    assert {r["deskew_status"] for r in G.deskew_decisions(df, off).collect()} == {"skipped"}
    assert {r["deskew_status"] for r in G.deskew_decisions(df, off, called=True).collect()} == {"disabled"}


def test_skew(spark):
    df = spark.createDataFrame([(1, 92.), (1, 92.), (1, 93.), (1, 130.), (2, 60.), (2, 60.)], "page_key int, theta double")
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_key int")
    rows = {r["page_key"]: (r["skew_angle"], r["skew_confidence"]) for r in G.skew_estimates(df, pages).collect()}
    assert rows == {1: (2.5, .75), 2: (0, 0), 3: (0, 0)}


def test_capture(spark):
    rows = [(.9, None), (.2, None), (.70, None), (.9, "broken")]
    df = spark.createDataFrame(rows, "white_fraction double, error string")
    got = C.capture_types(df, error="error").collect()
    assert [r["capture_type"] for r in got] == ["SCAN", "PHOTO", "PHOTO", "PHOTO"]
    assert [round(r["capture_confidence"], 6) for r in got] == [.4, 1.0, 0, 0]
    assert {r["capture_type"] for r in C.capture_types(df, Params(capture_enabled=False)).collect()} == {"PHOTO"}


def png(path, width, height, rows):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    raw = b"".join(b"\x00" + bytes(v for p in row for v in p) for row in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "white.png", 4, 4, [[(255, 255, 255)] * 4] * 4)
    png(tmp_path / "half.png", 4, 4, [[(255, 255, 255)] * 4] * 2 + [[(0, 0, 0)] * 4] * 2)
    png(tmp_path / "red.png", 2, 2, [[(255, 0, 0)] * 2] * 2)
    histograms = C.image_histograms(spark.read.format("image").load(str(tmp_path)))
    counts = C.histogram_counts(histograms)
    name = F.regexp_extract("path", "([a-z]+).png", 1)
    shares = {r["n"]: r["white_fraction"] for r in C.white_shares(counts, "path").withColumn("n", name).collect()}
    assert shares == {"white": 1.0, "half": .5, "red": 0.0}
    contrast = {r["n"]: r["contrast"] for r in C.contrasts(counts, "path").withColumn("n", name).collect()}
    assert contrast == {"white": 0, "half": 127.5, "red": 0}
    red = histograms.where(name == "red").first()["histogram"]
    assert red[76] == 4 and sum(red) == 4


STEP = "array<struct<transform_type: string, params: struct<angle: double, rotation_type: string, transform_matrix: array<array<double>>, output_size: array<bigint>>, `order`: int>>"


def moved(spark, steps, point=(10., 20.), size=(100, 200)):
    df = spark.createDataFrame([([list(point)], steps, *size)], f"corners array<array<double>>, transforms {STEP}, width int, height int")
    r = X.replay(df).first()
    return [round(v, 6) for v in r["moved"][0]], (r["final_width"], r["final_height"])


def test_replay(spark):
    def turn(angle, kind="standard", order=3):
        return ("rotation", (angle, kind, None, None), order)

    assert moved(spark, [turn(90.)]) == ([179, 10], (200, 100))
    assert moved(spark, [turn(180.)]) == ([89, 179], (100, 200))
    assert moved(spark, [turn(270.)]) == ([20, 89], (200, 100))
    assert moved(spark, [turn(0.)]) == ([10, 20], (100, 200))
    assert moved(spark, [("blur", (None, None, None, None), 1)]) == ([10, 20], (100, 200))
    scale = ("crop", (None, None, [[2., 0., 0.], [0., 2., 0.], [0., 0., 1.]], [200, 400]), 1)
    shift = ("deskew", (None, None, [[1., 0., 5.], [0., 1., 7.]], [100, 200]), 2)
    assert moved(spark, [shift, scale]) == ([25, 47], (100, 200))
    assert moved(spark, [("crop", (None, None, [[2., 0., 0.], [0., 2., 0.], [0., 0., 1.]], None), 1)]) == ([10, 20], (100, 200))
    four = moved(spark, [turn(90., order=i) for i in range(4)])
    assert four == ([10, 20], (100, 200))
    assert moved(spark, [turn(90., "arbitrary")]) == ([-30, 140], (100, 200))


def test_replay_of_a_perspective_crop(spark):
    m = [[1., 0., 0.], [0., 1., 0.], [0., 0.01, 1.]]
    assert moved(spark, [("crop", (None, None, m, [50, 50]), 1)]) == ([8.333333, 16.666667], (50, 50))


def test_a_log_is_replayed_by_columns(spark):
    schema = f"id int, width int, height int, corners array<array<double>>, transforms {STEP}"
    m = [[2., 0., 0.], [0., 2., 0.], [0., 0., 1.]]
    logs = [None, [], [("crop", (None, None, m, [50, 60]), 1)], [("deskew", (None, None, [m[0], None], [7, 8]), 1)], [("crop", (None, None, m[:2], [7]), 1)], [None, ("rotation", (90., None, None, None), None)]]
    df = X.replay(spark.createDataFrame([(i, 100, 200, [[10., 20.], None], t) for i, t in enumerate(logs)], schema).coalesce(1))
    assert [(r["moved"][0], r["final_width"], r["final_height"]) for r in df.orderBy("id").collect()] == [
        ([None, None], None, None), ([10, 20], 100, 200), ([20, 40], 50, 60), ([None, None], 7, 8), ([None, None], 7, None), ([179, 10], 200, 100)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan  # no interpreted fold for each page


def test_stable_order(spark):
    steps = [("a", (None,) * 4, 2), ("b", (None,) * 4, None), ("c", (None,) * 4, 2), ("d", (None,) * 4, 1)]
    df = spark.createDataFrame([(steps,)], f"t {STEP}")
    assert [t["transform_type"] for t in df.select(X.sorted_transforms(F.col("t")).alias("t")).first()["t"]] == ["b", "d", "a", "c"]


def test_a_page_without_size_is_a_row(spark):
    from pagemill.functions import quads
    row = spark.createDataFrame([(0, 0, [[0., 0.], [1., 0.], [1., 1.], [0., 1.]])], "width int, height int, corners array<array<double>>")
    first = row.select(quads.edge_margins(F.col("corners"), F.col("width"), F.col("height")).alias("m"),
                       quads.centred_margins(F.col("width"), F.col("height"), F.lit(1), F.lit(1)).alias("c")).first()
    assert list(first["m"]) == [None] * 4 and list(first["c"]) == [None] * 4
