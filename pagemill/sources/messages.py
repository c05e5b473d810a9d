"""Failed and queued messages: JSON text to columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.frames import once

SCHEMA = (
    "message_id string, actor_name string, args array<string>, kwargs map<string,string>, queue_name string,"
    " options struct<retries: bigint, max_retries: bigint>, retries bigint, max_retries bigint, message_timestamp bigint,"
    " _bad string"
)


def parse_messages(raw: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """Columns of each message with the defaults of absent keys. Text that is no JSON object is skipped, or
    kept with null columns. ``raw`` has (position, raw)."""
    parsed = once(raw, {"_m": F.from_json("raw", SCHEMA, {"columnNameOfCorruptRecord": "_bad"})})
    readable = F.col("_m").isNotNull() & F.col("_m._bad").isNull()
    rows = parsed if keep_malformed else parsed.where(readable)
    zero = F.lit(0).cast("bigint")

    def field(name: str):
        return F.when(readable, F.col(f"_m.{name}"))

    return rows.select(
        "position", "raw", field("message_id").alias("message_id"), field("actor_name").alias("actor_name"),
        F.coalesce(field("args"), F.array().cast("array<string>")).alias("args"),
        F.coalesce(field("kwargs"), F.create_map().cast("map<string,string>")).alias("kwargs"),
        field("queue_name").alias("queue_name"),
        F.coalesce(field("options"), F.struct(F.lit(None).cast("bigint").alias("retries"), F.lit(None).cast("bigint").alias("max_retries"))).alias("options"),
        F.coalesce(field("options.retries"), field("retries"), zero).alias("retries"),
        F.coalesce(field("options.max_retries"), field("max_retries"), zero).alias("max_retries"),
        field("message_timestamp").alias("sent_ms"),
    )


def parse_queue(raw: DataFrame) -> DataFrame:
    """Actor and first argument of queued messages."""
    return raw.select(
        F.get_json_object("raw", "$.actor_name").alias("actor_name"), F.get_json_object("raw", "$.args[0]").alias("first_arg"))
