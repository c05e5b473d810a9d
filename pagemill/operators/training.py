"""Training sets: labels, class indices, counts, stratified split, models."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.names import stem
from pagemill.operators.quantiles import positions
from pagemill.params import Params


def class_indices(files: DataFrame, label: str = "class_name") -> DataFrame:
    """0-based index of each class by name; the distinct names are range-sorted, not ranked in one task."""
    return positions(files.select(label).distinct(), [F.col(label)], name="class_index")


def labelled(files: DataFrame, label: str = "class_name") -> DataFrame:
    return files.join(class_indices(files, label), label)


def resolve_labels(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """Type per file, first hit of: mapping, type inside the file, name prefix before '_'; others are dropped."""
    prefix = F.when(F.contains(stem(F.col("file_name")), F.lit("_")), F.substring_index(stem(F.col("file_name")), "_", 1))
    mapped = files.join(mapping.select("file_name", "mapped_type"), "file_name", "left")
    return mapped.withColumn("document_type", F.coalesce("mapped_type", "json_type", prefix)).where("document_type IS NOT NULL").drop("mapped_type")


def type_counts(files: DataFrame) -> DataFrame:
    """Files, successes and failures per type, and the total as a row without a type."""
    return files.groupBy("document_type").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")
    )


def total_counts(counts: DataFrame) -> DataFrame:
    sums = counts.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("files", "succeeded", "failed")])
    return counts.unionByName(sums.select(F.lit("Total").alias("document_type"), "files", "succeeded", "failed"))


def unprocessed(inputs: DataFrame, outputs: DataFrame, key: str = "file_name") -> DataFrame:
    """Inputs without an existing output."""
    return inputs.join(outputs.select(key), key, "left_anti")


def hash_key(seed: int, *keys: str):
    """Deterministic pseudo-random order of rows, 0 .. 2^31 - 2, from the first digits of the MD5 of seed and ids."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("bigint").cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") % 2147483647


SPLIT_BUCKETS = 4096


def stratified_split(rows: DataFrame, label: str = "label", key: str = "vec_id", p: Params = Params()) -> DataFrame:
    """Adds ``is_test``: ceil(n * test_size) rows, spread over the classes in proportion (largest remainder).

    Within a class the rows with the smallest hash are taken. Hash buckets are counted first, so only the
    rows of the one bucket per class that the quota cuts are ranked; a class that holds a third of all
    rows is never sorted as a whole.
    """
    hashed = rows.withColumn("_h", hash_key(p.seed, key)).withColumn("_b", F.expr(f"_h div {2147483647 // SPLIT_BUCKETS + 1}"))
    sizes = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    classes = sizes.groupBy(label).agg(F.sum("_n").alias("_size"))
    everything = Window.partitionBy(F.lit(0))
    wanted = F.ceil(F.sum("_size").over(everything) * p.test_size)
    exact = F.col("_size") * F.col("_wanted") / F.sum("_size").over(everything)
    quotas = classes.withColumn("_wanted", wanted).withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    open_seats = F.col("_wanted") - F.sum("_floor").over(everything)
    by_remainder = everything.orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(label))
    quotas = quotas.withColumn("_open", open_seats).withColumn("_turn", F.row_number().over(by_remainder))
    quotas = quotas.withColumn("_classes", F.count(F.lit(1)).over(everything))
    too_small = F.raise_error(F.lit("test set smaller than the number of classes")).cast("bigint")
    quota = F.col("_floor") + F.when(F.col("_turn") <= F.col("_open"), 1).otherwise(0)
    quotas = quotas.select(label, F.when(F.col("_wanted") < F.col("_classes"), too_small).otherwise(quota).alias("_quota"))
    upto = F.sum("_n").over(Window.partitionBy(label).orderBy("_b"))
    cut = sizes.withColumn("_upto", upto).join(quotas, label).withColumn("_left", F.col("_quota") - (F.col("_upto") - F.col("_n")))
    plan = cut.select(label, "_b", "_n", "_left")
    judged = hashed.join(plan, [label, "_b"])
    whole_bucket = judged.where("_left <= 0 OR _left >= _n").withColumn("is_test", F.col("_left") >= F.col("_n"))
    split_bucket = judged.where("_left > 0 AND _left < _n").withColumn(
        "is_test", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) <= F.col("_left"))
    return whole_bucket.unionByName(split_bucket).drop("_h", "_b", "_n", "_left")


def features(rows: DataFrame, vector: str = "vector") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


#: Rows of one task of a forest.
TASK_ROWS = 20_000


def classifier(kind: str, p: Params = Params(), **overrides):
    """Untrained model: multinomial logistic regression or random forest (boosted trees: ``boosting.fit``)."""
    columns = {"featuresCol": "features", "labelCol": "label_index"}
    # Training settings.
    if kind == "logistic_regression":
        return LogisticRegression(**columns, **{"family": "multinomial", "maxIter": 1000, **overrides})
    if kind == "random_forest":
        return RandomForestClassifier(**columns, **{"numTrees": 100, "maxDepth": 10, "seed": p.seed, **overrides})
    raise ValueError(f"unknown model {kind!r}")


def train(rows: DataFrame, kind: str, label: str = "class_name", p: Params = Params(), **overrides) -> PipelineModel:
    """Fit on (features, label); class names are indexed by name and stored with the model.

    The rows are read once per iteration, so they are kept in memory or on disk while the model is fitted;
    a lost executor's share is computed again. For a forest they are dealt to tasks by their number: each task has
    sums for all new nodes of all trees, however few its rows, so sums grow with the rows and not with files or splits.
    """
    needed = rows.select("features", label).persist(StorageLevel.MEMORY_AND_DISK)
    held = [needed]
    try:
        if kind == "random_forest":
            needed = needed.repartition(max(1, -(-needed.count() // TASK_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(needed)
        indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc").fit(needed)
        back = IndexToString(inputCol="prediction", outputCol="predicted_name", labels=indexer.labels)
        return Pipeline(stages=[indexer, classifier(kind, p, **overrides), back]).fit(needed)
    finally:
        for kept in held:
            kept.unpersist()


def model_classes(model: PipelineModel, spark) -> DataFrame:
    """The class list stored with a model."""
    return spark.createDataFrame(list(enumerate(model.stages[0].labels)), "class_index bigint, class_name string")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
