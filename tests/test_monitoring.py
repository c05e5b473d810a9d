"""Histograms, quantiles, rates and gauges on literal rows."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import monitoring as M

S = 1_000_000


def test_histogram(spark):
    df = spark.createDataFrame([("a", v) for v in (.05, .1, .7, 3., 100.)], "k string, seconds double")
    arrays = M.histogram_arrays(df, ["k"])
    r = arrays.first()
    assert r["cumulative"] == [2, 2, 3, 3, 4, 4, 4, 4, 5] and r["observations"] == 5
    rows = M.histogram_rows(arrays, ["k"]).collect()
    assert rows[-1]["le"] == "+Inf" and [x["cumulative"] for x in rows] == sorted(x["cumulative"] for x in rows)


@pytest.mark.parametrize("cumulative,share,want", [
    ([10, 10, 10, 10, 10, 10, 10, 10, 10], .5, .05), ([0] * 9, .5, None), ([0, 0, 0, 0, 0, 0, 0, 0, 4], .5, 60.0),
    ([0, 4, 4, 4, 4, 4, 4, 4, 4], .5, .3), ([2, 2, 2, 2, 4, 4, 4, 4, 4], .95, 2 + 3 * .9)])
def test_quantiles(spark, cumulative, share, want):
    got = spark.createDataFrame([(cumulative,)], "c array<bigint>").select(M.bucket_quantile(F.col("c"), share)).first()[0]
    assert got == (pytest.approx(want) if want is not None else None)


def test_counter_with_reset(spark):
    rows = [("a", i, t * S, v) for i, (t, v) in enumerate([(0, 5), (60, 8), (299, 2), (310, 6), (1000, 1), (1001, 4)])]
    df = spark.createDataFrame(rows, "series string, event_id bigint, ts_us bigint, counter bigint")
    got = {r["window_start"]: (r["increase"], round(r["rate"], 6)) for r in M.counter_rates(df, ["series"]).collect()}
    assert got == {0: (5, round(5 / 300, 6)), 300: (4, round(4 / 300, 6)), 900: (4, round(4 / 300, 6))}


def test_sliding(spark):
    df = spark.createDataFrame([("x", 5 * S), ("x", 14 * S)], "k string, ts_us bigint")
    got = {r["window_start"]: r["events"] for r in M.sliding_rates(df, ["k"], 30, 10).collect()}
    assert got == {-20: 1, -10: 2, 0: 2, 10: 1}


def test_gauge_and_deadline(spark):
    df = spark.createDataFrame([("q", 1, 0, 5), ("q", 2, 9 * S, 7), ("q", 3, 10 * S, 1)], "queue string, event_id bigint, ts_us bigint, size bigint")
    assert {r["window_start"]: r["size"] for r in M.gauges(df, ["queue"]).collect()} == {0: 7, 10: 1}
    pages = spark.createDataFrame([(30.0,), (30.1,)], "seconds double")
    assert [r["error"] for r in M.page_deadlines(pages).collect()] == [None, "ocr_timeout"]
    assert M.stored_pages(pages).count() == 1
