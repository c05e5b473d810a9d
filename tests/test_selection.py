"""Exact medians by narrowing, and class indices, without a window over all rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pagemill.operators import geometry as G
from pagemill.operators import quantiles as Q
from pagemill.operators import training as T


def samples(kind, n):
    rng = random.Random(kind)
    return {"tail": lambda: [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(n)], "ties": lambda: [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(n)],
            "even": lambda: [float(i) for i in range(n)], "two": lambda: [1.0] * (n // 2) + [5.0] * (n - n // 2), "tiny": lambda: [5e-324 * i for i in range(n)]}[kind]()


@pytest.mark.parametrize("ranked,parts", [(40, 8), (4096, 64)])
def test_medians_of_any_distribution(spark, monkeypatch, ranked, parts):
    monkeypatch.setattr(Q, "RANKED", ranked)
    monkeypatch.setattr(Q, "PARTS", parts)
    groups = {f"{kind}{n}": samples(kind, n) for kind in ("tail", "ties", "even", "two", "tiny") for n in (1, 2, 7, 500)}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None), ("some", None), ("some", 3.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    expected = {k: statistics.median(v) for k, v in groups.items()} | {"some": 3.0}
    assert {r["k"]: r["median"] for r in Q.exact_median(frame, ["k"], "v").collect()} == expected
    for k in ("tail500", "even7"):
        assert [r["median"] for r in Q.exact_median(frame.where(F.col("k") == k), [], "v").collect()] == [expected[k]]
    assert Q.exact_median(frame.limit(0), [], "v").collect() == [] == Q.exact_median(frame.limit(0), ["k"], "v").collect()


def test_a_large_group_is_narrowed_before_it_is_ranked(spark):
    rows = spark.range(200_000).select((F.xxhash64("id") / 2.0**40).alias("v"))
    found = Q.exact_median(rows, [], "v")
    values = sorted(r["v"] for r in rows.collect())
    assert found.first()["median"] == (values[99_999] + values[100_000]) / 2
    plan = found._jdf.queryExecution().toString()
    assert plan.count("Window") and "_lo" in plan  # what the window sees is within the bounds
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("v", "_v")
    whole = counts.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_distinct")).withColumn("_below", F.lit(0))
    once = Q._narrowed(Q._inside(counts, whole, []), []).first()
    assert once["_distinct"] <= 200_000 * 3 / Q.PARTS and once["_below"] < 100_000 < once["_below"] + once["_distinct"] + 1


def test_skew_of_any_angles(spark):
    rng = random.Random(4)
    thetas = {k: [rng.uniform(60, 120) for _ in range(n)] for k, n in ((1, 9), (2, 400), (3, 1))}
    frame = spark.createDataFrame([(k, t) for k, values in thetas.items() for t in values] + [(4, None)], "page_key long, theta double")
    found = {r["page_key"]: r for r in G.skew_estimates(frame).collect()}
    assert found.keys() == {1, 2, 3}
    for k, values in thetas.items():
        angles = [a + 90 if a < -45 else a - 90 if a > 45 else a for a in (t - 90 for t in values)]
        median = statistics.median(angles)
        assert found[k]["skew_angle"] == pytest.approx(median) and found[k]["lines"] == len(values)
        assert found[k]["skew_confidence"] == pytest.approx(sum(abs(a - median) <= 1 for a in angles) / len(angles))


def test_skew_joins_nothing_for_pages_of_few_angles(spark):
    lines = spark.range(3000).select((F.col("id") % 700).alias("page_key"), (F.col("id") * 7 % 180).cast("double").alias("theta"))
    plan = G.skew_estimates(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Scan Existing" in plan and plan.count("ExistingRDD") == 1  # the counts, read once


@pytest.mark.parametrize("ranked", [3, 40, 4096])
def test_skew_of_few_and_many_angles_and_of_no_page_key(spark, monkeypatch, ranked):
    monkeypatch.setattr(Q, "RANKED", ranked)
    monkeypatch.setattr(Q, "PARTS", 8)
    rng = random.Random(11)
    sizes = {1: 1, 2: 3, 3: 4, 4: 300, 5: 41, None: 60}
    thetas = {k: [float(rng.randrange(860, 940)) / 10 for _ in range(n)] for k, n in sizes.items()}
    frame = spark.createDataFrame([(k, t) for k, values in thetas.items() for t in values], "page_key long, theta double").repartition(3)
    found = {r["page_key"]: r for r in G.skew_estimates(frame).collect()}
    assert found.keys() == sizes.keys()
    for k, values in thetas.items():
        angles = [t - 90 for t in values]
        median = statistics.median(angles)
        assert found[k]["skew_angle"] == pytest.approx(median) and found[k]["lines"] == sizes[k]
        assert found[k]["skew_confidence"] == pytest.approx(sum(abs(a - median) <= 1 for a in angles) / len(angles))


def test_class_indices_need_no_global_window(spark):
    files = spark.range(3000).select(F.concat(F.lit("c"), F.lpad(F.col("id") % 700, 4, "0")).alias("class_name"))
    found = T.class_indices(files)
    assert {r["class_name"]: r["class_index"] for r in found.collect()} == {f"c{i:04d}": i for i in range(700)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" not in plan
