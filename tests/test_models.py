"""Boosting against plain loops, and models scored from their tables against DuckDB and Spark's own models."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import boosting as G
from pagemill.operators import evaluation as E
from pagemill.operators import models as M
from pagemill.operators import training as T

SCALE = G.SCALE


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(300):
        k = int(rng.integers(0, 3))
        x = [float(v) for v in np.round(rng.normal(size=5), 2)]
        x[k] += 1.5
        out.append((i, f"c{k}", [None if rng.random() < 0.02 else v for v in x]))
    return spark.createDataFrame(out, "vec_id long, class_name string, features array<double>").repartition(3).cache()


def plain_fit(data, model, s):
    """One split at a time, best leaf first; sums by loops over rows."""
    classes = sorted({c for _, c, _ in data})
    y = np.array([classes.index(c) for _, c, _ in data])
    keys = np.array([k for k, _, _ in data])
    bins = [[len(e) if v is None else int(sum(v > x for x in e)) for v, e in zip(x, model.edges)] for _, _, x in data]
    scores = np.tile([math.log((y == k).mean()) for k in range(len(classes))], (len(data), 1))
    trees, losses = [], []
    for turn in range(s.rounds + 1):
        g, h, loss = G.gradients(scores, y)
        losses.append(loss.sum() / SCALE / len(data))
        best = min(range(len(losses)), key=losses.__getitem__)
        if turn == s.rounds or turn - best >= s.patience:
            return trees[:best], losses
        bag = set(np.flatnonzero(G.drawn(keys, turn // s.rows_every, s)).tolist())
        added, found = scores.copy(), []
        for k in range(len(classes)):
            allowed = G.chosen(turn, k, len(model.edges), s)

            def split(part):
                part = [i for i in part if i in bag]
                total = (sum(g[i, k] for i in part), sum(h[i, k] for i in part), len(part))
                top = None
                for f in range(len(model.edges)):
                    for b in range(s.bins - 1) if allowed[f] else ():
                        left = [i for i in part if bins[i][f] <= b]
                        n, lg, lh = len(left), sum(g[i, k] for i in left), sum(h[i, k] for i in left)
                        if n < s.least_rows or len(part) - n < s.least_rows or lh < s.least_hessian * SCALE or total[1] - lh < s.least_hessian * SCALE:
                            continue
                        gain = (lg**2 / lh + (total[0] - lg) ** 2 / (total[1] - lh) - total[0] ** 2 / total[1]) / SCALE
                        if gain > 1e-12 and (top is None or gain > top[0]):
                            top = gain, f, b
                return top, total

            leaves = [(list(range(len(data))), *split(range(len(data))))]
            splits = []
            while len(leaves) < s.leaves and any(t for _, t, _ in leaves):
                at = max((i for i in range(len(leaves)) if leaves[i][1]), key=lambda i: leaves[i][1][0])
                part, (gain, f, b), _ = leaves.pop(at)
                splits.append((f, b, round(gain, 9)))
                for side in ([i for i in part if bins[i][f] <= b], [i for i in part if bins[i][f] > b]):
                    leaves.append((side, *split(side)))
            for part, _, total in leaves:
                for i in part:
                    added[i, k] += -s.rate * total[0] / total[1] if splits else 0.0
            found.append(sorted(splits))
        scores = added
        trees.append(found)


@pytest.mark.parametrize("leaves,local", [(2, 0), (5, 0), (31, 0), (5, 60), (31, 60), (5, 1000), (31, 1000)])
def test_boosting_equals_plain_loops(spark, rows, monkeypatch, leaves, local):
    monkeypatch.setattr(G, "LOCAL", local)  # rows of a leaf that one task grows on its own
    s = G.Settings(rounds=3, leaves=leaves, bins=12, least_rows=8, rows_every=2)
    model = G.fit(rows, s=s)
    data = sorted((r["vec_id"], r["class_name"], r["features"]) for r in rows.collect())
    trees, losses = plain_fit(data, model, s)
    assert model.losses == pytest.approx(losses, abs=1e-9)
    got = [[sorted((int(f), int(b), round(float(x), 9)) for f, b, left, x in zip(t.feature, t.bin, t.left, t.gain) if left >= 0) for t in ts] for ts in model.trees]
    assert got == trees
    assert max(sum(t.left < 0) for ts in model.trees for t in ts) <= leaves


def test_boosting_does_not_depend_on_partitions(spark, rows):
    s = G.Settings(rounds=12, bins=20, least_rows=10)  # longer than a written state
    one, many = G.fit(rows.coalesce(1), s=s), G.fit(rows.repartition(7), s=s)
    assert one.nodes() == many.nodes() and one.losses == many.losses
    assert one.losses == sorted(one.losses, reverse=True)


def test_small_passes_give_the_same_trees(spark, rows, monkeypatch):
    s = G.Settings(rounds=2, bins=20, least_rows=10)
    whole = G.fit(rows, s=s)
    monkeypatch.setattr(G, "LOCAL", 0)
    monkeypatch.setattr(G, "PASS_BYTES", 20 * 5 * 24 * 2)
    monkeypatch.setattr(G, "BLOCK", 2)
    assert G.fit(rows, s=s).nodes() == whole.nodes()


def test_a_subtree_counts_only_the_smaller_half_of_each_split(monkeypatch):
    rng = np.random.default_rng(5)
    own, g = rng.integers(0, 20, (6000, 4)).astype(np.uint8), np.rint(rng.normal(size=6000) * SCALE)
    h, s, seen, plain = np.rint(rng.random(6000) * SCALE / 2), G.Settings(bins=20), [], G.counted
    monkeypatch.setattr(G, "counted", lambda own, *rest: seen.append(len(own)) or plain(own, *rest))
    nodes = G.grown(own, g, h, 20, np.ones(4, bool), s)
    inner = [n for n in nodes if n[3] >= 0]
    assert len(inner) == 30
    assert sum(seen) == 6000 + sum(min(nodes[n[3]][7], nodes[n[4]][7]) for n in inner)
    sums = plain(own, g, h, np.arange(4) * 20, 80).reshape(3, 4, 20)
    for f in range(4):
        for at, weights in enumerate((g, h, None)):
            assert sums[at, f].tolist() == np.bincount(own[:, f], weights, 20).tolist()


def test_keys_of_a_pass_are_dealt_evenly():
    s, rng = G.Settings(bins=20), np.random.default_rng(6)
    batch = G._state_batch(np.arange(500), rng.integers(0, 6, 500), rng.integers(0, 20, (500, 40)).astype(np.uint8), np.zeros((500, 6)))
    growing, slots = [G.Growth(s, 500).arrays() for _ in range(6)], [(k, 0) for k in range(6)]
    for local, parts in (({0, 1, 2, 3, 4, 5}, 6), ({1, 4}, 14), (set(), 6)):  # two keys of rows and four slots of three blocks; eighteen blocks
        keys = {(r["slot"], r["block"]): r["part"] for out in G._sums(40, 6, 20, growing, slots, local, 0, s, parts)(iter([batch])) for r in out.to_pylist() if r["slot"] >= 0}
        count = np.bincount(list(keys.values()), None, parts)
        assert len(keys) == len(local) + 3 * (6 - len(local)) and count.min() == count.max() == len(keys) // parts


def test_training_stops(spark):
    noise = spark.createDataFrame([(i, f"c{i % 2}", [float(i % 3)]) for i in range(40)], "vec_id long, class_name string, features array<double>")
    assert G.fit(noise, s=G.Settings(least_rows=30)).trees == []  # nothing can split
    model = G.fit(noise, s=G.Settings(rounds=40, rate=4.0, least_rows=1, patience=3))
    assert len(model.losses) < 41 and len(model.trees) == int(np.argmin(model.losses))
    with pytest.raises(ValueError):
        G.fit(noise.where("class_name = 'c0'"))
    with pytest.raises(ValueError):
        G.fit(noise.limit(0))


def sql_scores(con, kind):
    """(vec_id, class_index, score) of the tables ``inputs`` and ``model``."""
    if kind == "logistic_regression":
        return con.execute("""
            SELECT vec_id, class_index, sum(weight * coalesce(features[feature + 1], 1)) FROM inputs, model GROUP BY ALL""").fetchall()
    walk = """
        WITH RECURSIVE walk AS (
          SELECT vec_id, features, m.* FROM inputs i, model m WHERE node = 0
          UNION ALL SELECT w.vec_id, w.features, m.* FROM walk w JOIN model m ON m.tree = w.tree
            AND m.node = CASE WHEN coalesce(w.features[w.feature + 1] <= w.threshold, false) THEN w."left" ELSE w."right" END)"""
    if kind == "boosted_trees":
        return con.execute(walk + 'SELECT vec_id, class_index, sum(value) FROM walk WHERE "left" IS NULL GROUP BY ALL').fetchall()
    return con.execute(walk + """SELECT vec_id, k, avg(share) FROM (SELECT vec_id, unnest(range(len(shares))) AS k, unnest(shares) AS share FROM walk WHERE "left" IS NULL) GROUP BY ALL""").fetchall()


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest", "boosted_trees"])
def test_tables_score_as_in_sql(spark, rows, tmp_path, kind):
    full = rows.withColumn("features", F.transform("features", lambda x: F.coalesce(x, F.lit(0.0))))
    if kind == "boosted_trees":
        table = M.boosted_table(spark, G.fit(full, s=G.Settings(rounds=6, bins=20, least_rows=10)))
        reference = None
    else:
        fitted = T.train(T.features(full.withColumnRenamed("features", "v"), "v"), kind, **({"maxIter": 30} if kind == "logistic_regression" else {"numTrees": 7, "maxDepth": 4}))
        reference = fitted.transform(T.features(full.withColumnRenamed("features", "v"), "v")).select("vec_id", "probability")
        if kind == "random_forest":
            fitted.stages[1].write().save(f"{tmp_path}/forest")
            table = M.forest_table(spark, f"{tmp_path}/forest")
        else:
            table = M.linear_table(spark, fitted.stages[1])
    table.write.parquet(f"{tmp_path}/model")
    full.write.parquet(f"{tmp_path}/inputs")
    got = {r["vec_id"]: r["probabilities"] for r in M.probabilities(full, kind, spark.read.parquet(f"{tmp_path}/model")).collect()}
    con = duckdb.connect()
    for name in ("model", "inputs"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    expected = {}
    for vec_id, k, score in sql_scores(con, kind):
        expected.setdefault(vec_id, {})[k] = score
    assert got.keys() == expected.keys() and len(got) == 300
    for vec_id, by in expected.items():
        own = [by[k] for k in range(3)]
        if kind != "random_forest":
            own = G.softmax(np.array([own]))[0].tolist()
        assert got[vec_id] == pytest.approx(own, abs=1e-9)
    if reference:
        for r in reference.collect():
            assert got[r["vec_id"]] == pytest.approx(r["probability"].toArray().tolist(), abs=1e-9)


def test_forest_rows_are_dealt_by_their_number(spark, rows, monkeypatch):
    sizes = []

    class Caught:
        def __init__(self, stages):
            pass

        def fit(self, given):
            sizes.append(sorted(given.groupBy(F.spark_partition_id()).count().toPandas()["count"]))

    full = T.features(rows.select("class_name", F.transform("features", lambda x: F.coalesce(x, F.lit(0.0))).alias("v")), "v").repartition(40)
    monkeypatch.setattr(T, "Pipeline", Caught)
    T.train(full, "random_forest")
    monkeypatch.setattr(T, "TASK_ROWS", 100)
    T.train(full, "random_forest")
    assert sizes[0] == [300] and len(sizes[1]) == 3 and sizes[1][0] > 60


def test_importances(spark, rows, tmp_path):
    full = T.features(rows.select("vec_id", "class_name", F.transform("features", lambda x: F.coalesce(x, F.lit(0.0))).alias("v")), "v")
    model = T.train(full, "random_forest", numTrees=6, maxDepth=4).stages[1]
    model.write().save(f"{tmp_path}/forest")
    shares = {r["dim"]: r["importance"] for r in M.share_importances(M.forest_table(spark, f"{tmp_path}/forest")).collect()}
    assert [shares.get(i, 0.0) for i in range(5)] == pytest.approx(model.featureImportances.toArray().tolist(), abs=1e-9)
    boosted = G.fit(rows, s=G.Settings(rounds=4, bins=20, least_rows=10))
    gains = {}
    for *_, feature, _, left, _, _, gain in boosted.nodes():
        if left is not None:
            gains[feature] = gains.get(feature, 0.0) + gain
    found = M.gain_importances(M.boosted_table(spark, boosted))
    assert {r["dim"]: r["importance"] for r in found.collect()} == pytest.approx(gains)
    split = E.importance_split(found, 5, positional=2).first()
    assert split["text_percent"] == pytest.approx(100 * sum(v for k, v in gains.items() if k < 3) / sum(gains.values()))
    assert split["text_percent"] + split["position_percent"] == pytest.approx(100)
    assert E.importance_split(found.limit(0), 5).collect() == []
