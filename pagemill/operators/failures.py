"""Failed messages: parsing, statistics, listing, replay, removal, retry budget, backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.numbers import whole
from pagemill.params import Params
from pagemill.sources.messages import parse_messages

__all__ = ["parse_messages"]


def by_actor(messages: DataFrame) -> DataFrame:
    """Messages per actor; 'unknown' where the key is absent."""
    return messages.groupBy(F.coalesce("actor_name", F.lit("unknown")).alias("actor_name")).agg(F.count(F.lit(1)).alias("messages"))


def message_statistics(messages: DataFrame) -> DataFrame:
    """Total, oldest and newest sending time (0 is no time)."""
    sent = F.when(F.col("sent_ms") != 0, F.col("sent_ms"))
    return messages.agg(F.count(F.lit(1)).alias("total_messages"), F.min(sent).alias("oldest_ms"), F.max(sent).alias("newest_ms"))


def first_messages(messages: DataFrame, limit: int = 100) -> DataFrame:
    """The listing: first messages in queue order."""
    return messages.orderBy("position").limit(limit)


def message_details(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("message_id").distinct(), "message_id", "left_semi")


def without_messages(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """The store after removing the given ids; unreadable rows stay."""
    return parse_messages(raw, keep_malformed=True).join(ids.select("message_id").distinct(), "message_id", "left_anti").select("position", "raw")


def replayed(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """The requeued messages: options kept, retry counter reset."""
    parsed = parse_messages(raw).join(ids.select("message_id").distinct(), "message_id", "left_semi")
    return parsed.withColumn("options", F.col("options").withField("retries", F.lit(0).cast("bigint"))).withColumn("retries", F.lit(0).cast("bigint"))


def cleared(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The empty store and the number of removed messages."""
    return raw.limit(0), raw.agg(F.count(F.lit(1)).alias("removed"))


def retry_split(messages: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(requeue with one more retry, give up): at the retry budget a message goes to the failed store."""
    spent = F.col("retries") >= F.when(F.col("max_retries") > 0, F.col("max_retries")).otherwise(p.max_retries)
    judged = messages.withColumn("_spent", spent)
    again = judged.where(~F.col("_spent")).drop("_spent").withColumn("retries", F.col("retries") + 1)
    return again, judged.where("_spent").drop("_spent")


def live(rows: DataFrame, as_of_us: int, ttl_s: int, stamp_us: str) -> DataFrame:
    """Rows of an expiring store that are still readable at ``as_of_us``."""
    return rows.where(F.col(stamp_us) + F.lit(ttl_s * 1_000_000) > F.lit(as_of_us))


def backlog(messages: DataFrame) -> DataFrame:
    """Messages per queue; ('default', 0) when there is no queue at all."""
    counted = messages.where("queue_name IS NOT NULL").groupBy("queue_name").agg(F.count(F.lit(1)).alias("size"))
    seen = counted.agg(F.count(F.lit(1)).alias("queues")).where("queues = 0")
    return counted.unionByName(seen.select(F.lit("default").alias("queue_name"), whole(F.lit(0)).alias("size")))
