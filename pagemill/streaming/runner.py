"""Running streams: a session of their own, versioned sinks, and reading the newest version back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import ROCKSDB, run_dir
from pagemill.sinks.current import CurrentTable
from pagemill.sources.streams import mark_end, read_stream


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A sibling session for stateful jobs: state on local disk (RocksDB) with changelog checkpoints, and a
    partition count fixed for the life of the state. The caller's session keeps its settings."""
    sibling = spark.newSession()
    count = partitions or spark.sparkContext.defaultParallelism
    sibling.conf.set("spark.sql.shuffle.partitions", str(count))
    sibling.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    sibling.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    sibling.conf.set("spark.sql.session.timeZone", "UTC")
    return sibling


def versioned_sink(path: str, reduce: Callable[[DataFrame], DataFrame] | None = None):
    """A foreachBatch writer: one folder per batch, overwritten when a batch is repeated after a failure."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = reduce(batch) if reduce else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
          reduce: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(versioned_sink(path, reduce))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def drain(spark: SparkSession, name: str, stream: DataFrame, mode: str = "update",
          reduce: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process everything that is available, then return the written rows with their ``batch_id``."""
    base = run_dir(spark, name)
    start(stream, f"{base}/rows", f"{base}/checkpoint", mode, reduce).awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def drain_into(spark: SparkSession, table: CurrentTable, stream: DataFrame, checkpoint: str) -> DataFrame:
    """Merge everything that is available into a keyed table, then read its newest version."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(table.apply)
    writer.trigger(availableNow=True).start().awaitTermination()
    return table.read(spark)


def drain_to_end(spark: SparkSession, name: str, source: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """As ``drain``, for a bounded source: after its last file an end mark follows, which fires all timers still set."""
    base, session = run_dir(spark, name), source.sparkSession
    mark_end(session, f"{base}/marks", source.schema, False)
    stream = build(source.unionByName(read_stream(session, f"{base}/marks", source.schema)))
    for ended in (False, True):
        if ended:
            mark_end(session, f"{base}/marks", source.schema, True)
        start(stream, f"{base}/rows", f"{base}/checkpoint", mode).awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def newest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Last written version per key (update mode writes a key whenever it changes)."""
    rest = [c for c in versions.columns if c not in keys and c != "batch_id"]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")
