"""Task life cycle and age-based retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.params import Params

TERMINAL = ("completed", "failed")


def task_states(events: DataFrame) -> DataFrame:
    """Current state of every created task from its status events.

    Updates before the creation ('pending') belong to an unknown task and are ignored. Everything is a
    reduction per task, so repeated updates combine before the shuffle.
    """
    created = events.where("status = 'pending'").groupBy("task_id").agg(F.min(F.struct("ts_us", "event_id")).alias("_c"))
    known = events.join(created, "task_id").where(F.struct("ts_us", "event_id") >= F.col("_c"))
    at = F.struct("ts_us", "event_id")
    terminal = F.col("status").isin(*TERMINAL)
    return known.groupBy("task_id").agg(
        F.max_by("status", at).alias("status"),
        F.min("_c.ts_us").alias("created_us"),
        F.min(F.when(F.col("status") == "processing", F.col("ts_us"))).alias("started_us"),
        F.max(F.when(terminal, F.col("ts_us"))).alias("completed_us"),
        F.max_by("result", F.when(F.col("result").isNotNull(), at)).alias("result"),
        F.max_by("error", F.when(F.col("error").isNotNull(), at)).alias("error"),
    )


def expired_tasks(tasks: DataFrame, as_of_us: int, p: Params = Params()) -> DataFrame:
    """Adds ``expired``: finished before the cutoff and still in a final state."""
    cutoff = F.lit(as_of_us - p.task_retention_s * 1_000_000)
    old = F.col("status").isin(*TERMINAL) & (F.col("completed_us") < cutoff)
    return tasks.withColumn("expired", F.coalesce(old, F.lit(False)))


def expired_files(files: DataFrame, as_of_us: int, max_age_s: int | None = None, p: Params = Params()) -> DataFrame:
    """Adds ``expired``: last modified before the cutoff. Metadata files go with their file, not by age."""
    age = p.file_retention_s if max_age_s is None else max_age_s
    old = F.col("modified_us") < F.lit(as_of_us - age * 1_000_000)
    return files.withColumn("expired", old & ~F.endswith(F.col("path"), F.lit(".meta")))


def retained(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) after one of the functions above."""
    return judged.where(~F.col("expired")).drop("expired"), judged.where("expired").drop("expired")
