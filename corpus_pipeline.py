"""The corpus pipeline: reject bad documents, drop repeated lines and near-copies, mix the sources, pack sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes each stage's result
as Parquet below the shared checkpoint folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import line_dedup, mixing, near, packing, quality
from pagemill.llm.common import documents, prepare
from pagemill.session import run_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    prepare(spark)
    return quality.keep_good(docs, *quality.fit(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    prepare(spark)
    kept = line_dedup.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; texts are linked at a Jaccard share of 0.8 of their five-word shingles, checked exactly."""
    prepare(spark)
    return near.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate has it drawn."""
    prepare(spark)
    return mixing.mix(docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    prepare(spark)
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: The fitted classifier, fingerprints and tokens are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, below = documents(spark, sf_dir), run_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{below}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
