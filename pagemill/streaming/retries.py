"""Failed messages as a stream: requeue or give up, each batch split into two sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagemill.operators.failures import retry_split
from pagemill.params import Params
from pagemill.sources.messages import parse_messages


def split_sinks(requeue: str, failed: str, p: Params = Params()):
    """A foreachBatch writer; a repeated batch overwrites its own folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        messages = parse_messages(batch)
        again, spent = retry_split(messages, p)
        again.write.mode("overwrite").parquet(f"{requeue}/batch_id={batch_id}")
        spent.write.mode("overwrite").parquet(f"{failed}/batch_id={batch_id}")

    return write


def start_retries(raw: DataFrame, requeue: str, failed: str, checkpoint: str, p: Params = Params()):
    return raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(split_sinks(requeue, failed, p)).trigger(availableNow=True).start()
