"""File-directory streams with bounded batches."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_PER_BATCH = 10
# An event time after every real one: a row with it ends a bounded source, so that all timers run.
END = "2200-01-01 00:00:00"


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Files of a folder (or matching a glob) as a stream, a fixed number per micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The events table as a stream, with ``ts`` as an instant (watermarks need one)."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # The pattern matches the table as one file and as a folder of part files.
    raw = read_stream(spark, f"{sf_dir}/events.parque[t]", schema, files_per_batch=files_per_batch)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ts_us", F.unix_micros("ts"))


def mark_end(spark: SparkSession, folder: str, schema, ended: bool) -> None:
    """Opens a folder of end marks (``ended`` false: no row), or adds the mark: a row of nulls but for ``ts``."""
    columns = [F.lit(END if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1 if ended else 0).select(*columns).write.mode("append").parquet(folder)


def timed_rows(rows: DataFrame, present: list[str], delay: str) -> DataFrame:
    """Rows whose ``present`` columns are not null, under a watermark on ``ts`` that also sees end marks, which then go.

    Filters that do not read the event time move in front of the watermark and would take the marks with them, so the one on
    ``present`` lets them pass, and the one behind the watermark reads only the event time.
    """
    end = F.lit(END).cast("timestamp")
    known = reduce(and_, [F.col(c).isNotNull() for c in present])
    return rows.where(known | (F.col("ts") >= end)).withWatermark("ts", delay).where(F.col("ts") < end)
