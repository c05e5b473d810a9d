"""Quality flags, statistics and report tables on literal rows."""

import statistics

import pytest
from pyspark.sql import functions as F

from pagemill.operators import quality as Q
from pagemill.operators.quantiles import exact_median, positions

SCHEMA = ("page string, orientation_confidence double, orientation_angle double, deskew_angle double, deskew_confidence double, deskew_status string,"
          " crop_status string, has_matrix boolean, margin_top double, margin_bottom double, margin_left double, margin_right double,"
          " contrast double, final_width bigint, final_height bigint, processing_time double, capture_type string, white_fraction double")
BASE = dict(page="p", orientation_confidence=.9, orientation_angle=0., deskew_angle=0., deskew_confidence=.0, deskew_status="skipped",
            crop_status="skipped", has_matrix=False, margin_top=20., margin_bottom=20., margin_left=20., margin_right=20., contrast=80.,
            final_width=1200, final_height=1600, processing_time=1., capture_type="PHOTO", white_fraction=.1)


def frame(spark, *changes):
    rows = [{**BASE, **c} for c in changes]
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows], SCHEMA)


NAMES = Q.WARNINGS + ["dewarp_applied", "rotated", "rotation_applied"]


@pytest.mark.parametrize("change,want", [
    ({}, set()),
    ({"orientation_confidence": .69}, {"low_confidence_orientation"}),
    ({"orientation_confidence": None}, {"low_confidence_orientation"}),
    ({"crop_status": "cropped", "margin_left": 7.9}, {"overcrop_risk"}),
    ({"crop_status": "rejected_overcrop", "margin_left": 1.}, set()),
    ({"crop_status": "no_detection"}, {"no_quad_detected"}),
    ({"crop_status": "invalid_geometry"}, {"no_quad_detected"}),
    ({"crop_status": "cropped", "has_matrix": True}, {"dewarp_applied"}),
    ({"contrast": 49.9}, {"low_contrast_after_enhance"}),
    ({"final_width": 1199}, {"too_small_final"}),
    ({"final_height": 1599}, {"too_small_final"}),
    ({"orientation_angle": 90.}, {"rotated", "rotation_applied"}),
    ({"orientation_angle": 90., "orientation_confidence": .5}, {"rotated", "low_confidence_orientation"}),
])
def test_flags(spark, change, want):
    r = Q.quality_flags(frame(spark, change)).first()
    assert {n for n in NAMES if r[n]} == want


def test_flag_statistics(spark):
    flags = Q.quality_flags(frame(
        spark, {"processing_time": 1.0, "crop_status": "cropped", "margin_top": 1., "has_matrix": True},
        {"processing_time": 2.0, "orientation_confidence": .1, "crop_status": "no_detection"}, {"processing_time": 1.5, "contrast": 1., "final_width": 1}))
    r = Q.flag_statistics(flags).first()
    assert r["orientation_accuracy"] == pytest.approx(2 / 3) and r["overcrop_risk_count"] == 1 and r["overcrop_risk_rate"] == pytest.approx(1 / 3)
    assert (r["no_quad_detected_count"], r["dewarp_applied_count"], r["low_contrast_count"], r["too_small_count"]) == (1, 1, 1, 1)
    assert r["avg_processing_time"] == 1.5 and r["pages_with_flags"] == 3
    assert Q.flag_statistics(flags.limit(0)).count() == 0


def test_report_statistics(spark):
    flags = Q.quality_flags(frame(
        spark, {"processing_time": 0.}, {"processing_time": 2., "deskew_angle": -3., "deskew_confidence": .5, "deskew_status": "success"},
        {"processing_time": 10., "crop_status": "cropped", "has_matrix": True, "capture_type": "SCAN"}, {"processing_time": 3., "capture_type": None}))
    r = Q.report_statistics(flags).first()
    assert (r["avg_time"], r["median_time"], r["min_time"], r["max_time"]) == (5, 3, 2, 10)
    assert (r["avg_deskew_angle"], r["avg_deskew_confidence"], r["deskews_applied"]) == (.75, .5, 1)
    assert (r["scan_count"], r["photo_count"], r["crops_applied"], r["pages_with_warnings"]) == (1, 2, 1, 0)
    assert (r["time_spread"], r["mean_median_gap"]) == (8, 2)
    warned = Q.time_warnings(Q.report_statistics(flags)).first()
    assert warned["time_warning"] == "outliers"
    empty = Q.report_statistics(flags.limit(0)).first()
    assert empty["pages"] == 0 and empty["avg_time"] == 0 and empty["median_time"] == 0


def test_badges(spark):
    flags = Q.quality_flags(frame(spark, {"crop_status": "already_cropped", "deskew_status": "success", "orientation_angle": 90.}))
    states = {r["badge"]: r["state"] for r in Q.badges(flags, ["page"]).collect()}
    assert states == {"Rotation": "applied", "Deskew": "applied", "Crop": "skipped", "Dewarp": "inactive", "Capture Type": "info",
                      "Low Conf": "inactive", "Overcrop": "inactive", "No Quad": "inactive", "Low Contrast": "inactive", "Too Small": "inactive"}


def test_margins(spark):
    rows = [([[100., 50.], [900., 60.], [880., 1900.], [90., 1800.]], 1000, 2000, 0, 0), (None, 1000, 2000, 500, 1800)]
    df = spark.createDataFrame(rows, "source_points array<array<double>>, width int, height int, final_width int, final_height int")
    got = [[r[m] for m in Q.MARGINS] for r in Q.crop_margins(df).collect()]
    assert got == [[2.5, 5, 9, 10], [25, 25, 25, 25]]


def test_table_orders(spark):
    df = spark.createDataFrame([("B", .5, True), ("a", 0., False), ("C", .9, True)], "page string, c double, f boolean")
    assert [r["page"] for r in Q.flag_table(df, "c", "confidence").collect()] == ["a", "B", "C"]
    assert [r["page"] for r in Q.flag_table(df, "page", "text").collect()] == ["a", "B", "C"]
    assert [r["page"] for r in Q.flag_table(df, "f", "flag", False, ["page"]).collect()] == ["B", "C", "a"]


def test_sidecars_without_an_image_count_only_in_the_total(spark):
    from pagemill.sinks.tables import metadata_document

    flags = Q.quality_flags(frame(spark, {"page": "a"}, {"page": "b"}, {"page": "c"})).withColumn("path", F.concat(F.lit("o/"), "page", F.lit(".qa.json")))
    images = spark.createDataFrame([("o/a.png",), ("o/a.jpg",), ("o/b.jpg",), ("o/d.png",)], "path string")
    kept = Q.sidecar_pages(flags, images)
    assert {r["image_path"] for r in kept.collect()} == {"o/a.png", "o/b.jpg"}
    r = metadata_document(flags, kept).first()
    assert (r["total_pages"], r["pages"]) == (3, 2)
    assert metadata_document(flags, kept.limit(0)).first()["total_pages"] == 3


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 20000])
def test_exact_median(spark, n):
    values = [((i * 7919) % 10007) / 7 for i in range(n)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    assert exact_median(df, ["k"], "v").first()["median"] == pytest.approx(statistics.median(values))


def test_exact_median_of_a_hot_key(spark):
    hot = spark.range(60000).select(F.lit("hot").alias("k"), (F.col("id") * 31 % 60000).cast("double").alias("v"))
    cold = spark.range(30).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    got = {r["k"]: r["median"] for r in exact_median(hot.unionByName(cold), ["k"], "v").collect()}
    assert got == {"hot": 29999.5, "0": 13.5, "1": 14.5, "2": 15.5}


def test_positions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("k"))
    rows = positions(df, [F.col("v")]).collect()
    assert all(r["position"] == r["v"] for r in rows) and len(rows) == 5000
    keyed = sorted((r["k"], r["v"], r["position"]) for r in positions(df, [F.col("v")], ["k"]).collect())
    for k in range(3):
        assert [p for kk, _, p in keyed if kk == k] == list(range(sum(1 for x in keyed if x[0] == k)))
