"""Documents that never got a final result, and the requests that restart them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.documents import with_filenames
from pagemill.params import Params
from pagemill.sources.messages import parse_queue

# Fixed value: the actor that finalises a document.
FINAL_ACTOR = "finalize_document_task"


def unfinished(documents: DataFrame, finals: DataFrame, queued: DataFrame) -> DataFrame:
    """Documents without a final result and without a queued finalise request (failed requests do not protect)."""
    pending = parse_queue(queued).where(F.col("actor_name") == FINAL_ACTOR).select(F.col("first_arg").alias("_key"))
    open_docs = documents.join(finals.select("document_id"), "document_id", "left_anti")
    return open_docs.withColumn("_key", F.col("document_id").cast("string")).join(pending, "_key", "left_anti").drop("_key")


def document_ages(pages: DataFrame, as_of_us: int) -> DataFrame:
    """Known pages, pages with a stored result, newest result and its age per document.

    Pages are made distinct by (document, page) before they are counted per document.
    """
    distinct = pages.groupBy("document_id", "page_index").agg(
        F.max(F.when(F.col("has_result"), F.col("ts_us"))).alias("newest"))
    profile = distinct.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("num_pages"), F.count("newest").alias("pages_with_results"), F.max("newest").alias("latest_us"))
    age = (F.lit(as_of_us) - F.col("latest_us")).cast("double") / 1_000_000
    return profile.where("pages_with_results > 0").withColumn("age_seconds", age)


def stale_documents(pages: DataFrame, finals: DataFrame, queued: DataFrame, as_of_us: int, p: Params = Params()) -> DataFrame:
    aged = document_ages(pages, as_of_us).where(F.col("age_seconds") >= p.stale_after_s)
    return unfinished(aged, finals, queued)


def restart_requests(stale: DataFrame, names: DataFrame) -> DataFrame:
    """Finalise requests for stale documents: id, file name (or its default), known pages."""
    named = with_filenames(stale, names.select("document_id", "filename"))
    return named.select(F.lit(FINAL_ACTOR).alias("actor_name"), "document_id", "filename", "num_pages")
