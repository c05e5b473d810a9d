"""Class scores to document types."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.numbers import first_max_index, softmax
from pagemill.params import Params


def best_class(rows: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Index of the first highest probability and that probability."""
    return rows.withColumns({
        "class_index": first_max_index(F.col(probabilities)), "confidence": F.array_max(probabilities)})


def fixed_class(rows: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Models without probabilities: the predicted index with confidence 1."""
    return rows.withColumns({"class_index": F.col(prediction).cast("bigint"), "confidence": F.lit(1.0)})


def class_names(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Name of the predicted class; the index as text when the class list does not know it."""
    named = rows.join(classes.select("class_index", F.col("class_name").alias("_name")), "class_index", "left")
    return named.withColumn("document_type", F.coalesce("_name", F.col("class_index").cast("string"))).drop("_name")


def reject_unsure(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """Below the threshold the type is dropped, the confidence stays."""
    return rows.withColumn("document_type", F.when(F.col("confidence") >= p.class_min_confidence, F.col("document_type")))


def score(rows: DataFrame, classes: DataFrame, p: Params = Params(), probabilities: str = "probabilities") -> DataFrame:
    return reject_unsure(class_names(best_class(rows, probabilities), classes), p)


def probabilities(scores: Column) -> Column:
    return softmax(scores)


def score_with_model(rows: DataFrame, model, classes: DataFrame, p: Params = Params()) -> DataFrame:
    """Batch scoring with a fitted model; a model without probabilities is fully confident."""
    scored = model.transform(rows)
    if "probability" in scored.columns:
        judged = best_class(scored.withColumn("probabilities", vector_to_array("probability")))
    else:
        judged = fixed_class(scored)
    return reject_unsure(class_names(judged, classes), p)


def type_summary(results: DataFrame) -> DataFrame:
    """Documents per type, 'Unknown' for none, sorted by name."""
    kind = F.coalesce("document_type", F.lit("Unknown")).alias("document_type")
    return results.groupBy(kind).agg(F.count(F.lit(1)).alias("documents")).orderBy("document_type")
