"""Evaluation of predictions: confusion matrix, per-class report, averages, importance split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.numbers import ratio


def confusion(predictions: DataFrame, fill: bool = False) -> DataFrame:
    """(label, prediction, n) of the pairs that occur; with ``fill`` also those of two occurring classes that never do, as 0.

    The filled grid has classes x classes rows, as the matrix that is shown and that of the long report have.
    """
    pairs = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    if not fill:
        return pairs
    seen = pairs.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    every = seen.agg(F.sort_array(F.collect_set("c")).alias("classes"))
    grid = every.select(F.explode("classes").alias("label"), "classes").select("label", F.explode("classes").alias("prediction"))
    return grid.join(pairs, ["label", "prediction"], "left").na.fill(0, ["n"])


def class_report(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support for every class of the list, also those without test rows."""
    pairs = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = pairs.groupBy(F.col("label").alias("class_index")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("support"))
    guessed = pairs.groupBy(F.col("prediction").alias("class_index")).agg(F.sum("n").alias("predicted"))
    full = classes.select("class_index", "class_name").join(actual, "class_index", "left").join(guessed, "class_index", "left")
    full = full.na.fill(0, ["tp", "support", "predicted"])
    measured = full.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return measured.withColumn("f1", f1).select("class_index", "class_name", "precision", "recall", "f1", "support", "tp")


def averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages, one row each."""
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    sums = report.agg(
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[ratio(F.sum(F.col(n) * F.col("support")), total).alias(f"weighted_{n}") for n in names],
        total.alias("support"),
    )
    rows = F.array(*[
        F.struct(F.lit(f"{kind} avg").alias("average"), *[F.col(f"{kind}_{n}").alias(n) for n in names], F.col("support").cast("bigint").alias("support"))
        for kind in ("macro", "weighted")
    ])
    return sums.select(F.inline(rows))


def accuracy(predictions: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    hits = F.count_if(F.col("label") == F.col("prediction"))
    return predictions.agg(ratio(hits, total).alias("accuracy"), total.alias("rows"))


def importance_split(importances: DataFrame, width: int, positional: int = 4) -> DataFrame:
    """Share of importance of the text part and of the last positions, in percent; no row when all is zero.

    ``importances`` (dim, importance) may leave out features without any; ``width`` is their number.
    """
    text = F.col("dim") < width - positional
    total = F.sum("importance")
    return importances.agg(
        (F.sum(F.when(text, F.col("importance")).otherwise(0.0)) / F.nullif(total, F.lit(0.0)) * 100).alias("text_percent"),
        (F.sum(F.when(~text, F.col("importance")).otherwise(0.0)) / F.nullif(total, F.lit(0.0)) * 100).alias("position_percent"),
    ).where("text_percent IS NOT NULL")


def evaluation_report(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """Everything in one long table: (section, name, metric, value); the matrix with its empty cells, as 0."""
    report = class_report(predictions, classes)
    measures = ["precision", "recall", "f1", "support"]
    typed = report.select("class_name", *[F.col(m).cast("double").alias(m) for m in measures])
    per_class = typed.unpivot(["class_name"], measures, "metric", "value").select(
        F.lit("class").alias("section"), F.col("class_name").alias("name"), "metric", "value")
    avg = averages(report).select("average", *[F.col(m).cast("double").alias(m) for m in measures])
    overall = avg.unpivot(["average"], measures, "metric", "value").select(
        F.lit("average").alias("section"), F.col("average").alias("name"), "metric", "value")
    cells = confusion(predictions, fill=True).select(
        F.lit("matrix").alias("section"), F.col("label").cast("string").alias("name"),
        F.col("prediction").cast("string").alias("metric"), F.col("n").cast("double").alias("value"))
    share = accuracy(predictions).select(
        F.lit("overall").alias("section"), F.lit("all").alias("name"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    return per_class.unionByName(overall).unionByName(cells).unionByName(share)



def report_document(predictions: DataFrame, classes: DataFrame, generated_at: str, model_path: str, data_path: str, importance: DataFrame | None = None) -> DataFrame:
    """The evaluation as one nested row: when and of what, the class list with its measures, averages, accuracy, the pairs of the matrix, and importances.

    Its arrays are as long as the class list, and as there are pairs of classes that occur; no empty cell is made.
    """
    report = class_report(predictions, classes)
    measures = ["precision", "recall", "f1"]
    listed = report.agg(F.sort_array(F.collect_list(F.struct("class_index", "class_name", "support", *measures))).alias("classes"))
    cells = confusion(predictions).agg(F.sort_array(F.collect_list(F.struct("label", "prediction", "n"))).alias("matrix"))
    average = averages(report).agg(F.sort_array(F.collect_list(F.struct("average", *measures, "support"))).alias("averages"))
    overall = accuracy(predictions)
    one = lambda rows, *names: rows.select(F.struct(*names)).scalar()
    facts = overall.select(F.lit(generated_at).alias("generated_at"), F.lit(model_path).alias("model_path"), F.lit(data_path).alias("data_path"), "accuracy", F.col("rows").alias("test_rows"))
    facts = facts.withColumn("classes", one(listed, "classes")["classes"]).withColumn("matrix", one(cells, "matrix")["matrix"]).withColumn("averages", one(average, "averages")["averages"])
    if importance is None:
        return facts.withColumn("feature_importance", F.lit(None).cast("struct<text_percent: double, position_percent: double>"))
    return facts.withColumn("feature_importance", one(importance, "text_percent", "position_percent"))


def write_report(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)
