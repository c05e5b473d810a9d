"""Fitted models as tables, and scoring and importances from these tables.

A linear model is (class_index, feature, weight), the intercept without a feature. Trees are (tree, class_index, node,
feature, threshold, left, right, value, shares, gain, rows): a row goes left where its feature is at most the threshold, from
node 0 on, and ends at a node without children; a missing feature goes right. ``value`` adds to the score of the tree's
class, ``shares`` holds a share for every class. A table has as many rows as the model has parameters, whatever it was
trained on. Scoring shuffles nothing: linear scores are column expressions, trees are walked over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.frames import once
from pagemill.functions.numbers import softmax
from pagemill.operators.boosting import Model
from pagemill.session import ship

LINEAR = "class_index bigint, feature int, weight double"
#: Rows that all trees are walked for at once.
ROWS = 500
TREES = "tree int, class_index int, node int, feature int, threshold double, left int, right int, value double, shares array<double>, gain double, rows bigint"


def linear_table(spark: SparkSession, model) -> DataFrame:
    """A fitted multinomial logistic regression."""
    weights = [(k, i, float(w)) for k, row in enumerate(model.coefficientMatrix.toArray()) for i, w in enumerate(row)]
    return spark.createDataFrame(weights + [(k, None, float(w)) for k, w in enumerate(model.interceptVector.toArray())], LINEAR)


def forest_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved random forest; ``path`` is that of the model itself."""
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    total = F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    only = lambda value: F.when(inner, value)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.lit(None).cast("int").alias("class_index"), n["id"].alias("node"), only(n["split"]["featureIndex"]).alias("feature"),
        only(n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"), only(n["leftChild"]).alias("left"), only(n["rightChild"]).alias("right"),
        F.lit(None).cast("double").alias("value"), F.transform(n["impurityStats"], lambda x: x / total).alias("shares"),
        F.greatest(n["gain"], F.lit(0.0)).alias("gain"), n["rawCount"].alias("rows"))


def boosted_table(spark: SparkSession, model: Model) -> DataFrame:
    """Boosted trees in the order of their rounds, and the scores all rows start from as one leaf for each class."""
    classes = len(model.classes)
    rows = [(k, k, 0, None, None, None, None, float(x), None, 0.0, None) for k, x in enumerate(model.start)]
    rows += [((r + 1) * classes + k, k, node, feature, threshold, left, right, value, None, gain, None) for r, k, node, feature, threshold, left, right, value, gain in model.nodes()]
    return spark.createDataFrame(rows, TREES)


def linear_scores(rows: DataFrame, table: DataFrame, features: str, name: str) -> DataFrame:
    """Adds the score of each class: its weights times the features, and its intercept."""
    by_class = table.groupBy("class_index").agg(
        F.sort_array(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "weight")))).alias("weights"), F.sum(F.when(F.col("feature").isNull(), F.col("weight"))).alias("intercept"))
    whole = by_class.agg(F.sort_array(F.collect_list(F.struct("class_index", "weights", "intercept")))).scalar()  # a value for each class and feature

    def score(c: Column) -> Column:
        products = F.zip_with(c["weights"], F.col(features), lambda w, x: w["weight"] * x)
        return F.aggregate(products, F.coalesce(c["intercept"], F.lit(0.0)), lambda a, x: a + x)

    held = rows.withColumn("_model", whole)
    return once(held, {name: F.transform("_model", score)}).drop("_model")


class Trees:
    """All trees of a table as flat arrays."""

    def __init__(self, nodes: list):
        nodes = sorted(nodes, key=lambda r: (r["tree"], r["node"]))
        heads = [i for i, r in enumerate(nodes) if i == 0 or r["tree"] != nodes[i - 1]["tree"]]
        first = np.repeat(heads, np.diff([*heads, len(nodes)])) if nodes else np.zeros(0, np.int64)
        pick = lambda name, none, kind: np.array([none if r[name] is None else r[name] for r in nodes], kind)
        self.roots, self.of_class = np.array(heads, np.int64), np.array([-1 if nodes[i]["class_index"] is None else nodes[i]["class_index"] for i in heads], np.int64)
        self.feature, self.threshold, self.value = pick("feature", -1, np.int64), pick("threshold", np.nan, np.float64), pick("value", 0.0, np.float64)
        self.left, self.right = first + pick("left", 0, np.int64), first + pick("right", 0, np.int64)
        self.shares = np.array([r["shares"] or [] for r in nodes], np.float64) if nodes and nodes[0]["shares"] is not None else None

    def leaves(self, values: np.ndarray) -> np.ndarray:
        """(row, tree): the number of the node where each row ends."""
        at = np.tile(self.roots, (len(values), 1))
        while True:
            row, tree = np.nonzero(self.feature[at] >= 0)
            if not len(row):
                return at
            here = at[row, tree]
            left = values[row, self.feature[here]] <= self.threshold[here]  # never for what is missing
            at[row, tree] = np.where(left, self.left[here], self.right[here])

    def scores(self, values: np.ndarray) -> np.ndarray:
        leaves = self.leaves(values)
        if self.shares is not None:
            return self.shares[leaves].mean(axis=1)
        own = self.value[leaves]
        return np.stack([own[:, self.of_class == k].sum(axis=1) for k in range(self.of_class.max() + 1)], axis=1)


def tree_scores(rows: DataFrame, table: DataFrame, features: str, name: str) -> DataFrame:
    """Adds what the trees say of each class: the sum of its trees' values, or the mean of all trees' shares."""
    trees = Trees(table.drop("gain", "rows").collect())  # a row for each node of the model
    width = int(trees.feature.max(initial=-1)) + 1

    @F.arrow_udf("array<double>")
    def scored(column: pa.Array) -> pa.Array:
        values = np.full((len(column), max(width, 1)), np.nan)
        for i, row in enumerate(column.to_pylist()):
            own = np.array([np.nan if v is None else v for v in row or ()][:width], np.float64)
            values[i, : len(own)] = own
        found = [trees.scores(values[a : a + ROWS]) for a in range(0, len(values), ROWS)]
        return pa.array([list(x) for part in found for x in part], pa.list_(pa.float64()))

    return rows.withColumn(name, scored(F.col(features).cast("array<double>")))


def probabilities(rows: DataFrame, kind: str, table: DataFrame, features: str = "features") -> DataFrame:
    """Adds ``probabilities`` of all classes, from a model's table."""
    ship(rows.sparkSession)
    if kind == "random_forest":
        return tree_scores(rows, table, features, "probabilities")
    if kind in ("logistic_regression", "boosted_trees"):
        scored = (linear_scores if kind == "logistic_regression" else tree_scores)(rows, table, features, "_scores")
        return scored.withColumn("probabilities", softmax(F.col("_scores"))).drop("_scores")
    raise ValueError(f"unknown model {kind!r}")


def gain_importances(table: DataFrame) -> DataFrame:
    """(dim, importance): the gain of all splits at a feature."""
    return table.where("left IS NOT NULL").groupBy(F.col("feature").cast("bigint").alias("dim")).agg(F.sum("gain").alias("importance"))


def share_importances(table: DataFrame) -> DataFrame:
    """(dim, importance): the mean over the trees of each feature's share of the tree's gain, weighted by rows; adds up to 1."""
    by_tree = table.where("left IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("own"))
    totals = by_tree.groupBy("tree").agg(F.sum("own").alias("whole")).where("whole > 0")
    sums = by_tree.join(totals, "tree").groupBy(F.col("feature").cast("bigint").alias("dim")).agg(F.sum(F.col("own") / F.col("whole")).alias("share"))
    everything = totals.agg(F.count(F.lit(1))).scalar()
    return sums.select("dim", (F.col("share") / everything).alias("importance"))
