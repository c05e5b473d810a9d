"""Mixing sources to target weights by Poisson replication.

Every document draws its number of copies from the Poisson distribution whose mean is the repetition rate of its
source: the inverse of the distribution at a uniform number hashed from seed and doc_id. Rates come from the
characters of all documents per source, so the expected characters of a source are its weight times the budget.
The copies are ordered by a hash of (seed, doc_id, copy), dealt over range partitions.

Defined cases: a null source is a source of its own, a null text has no characters, a null doc_id hashes as the text
``null``. Rows of one doc_id draw equal counts. If no source has characters, or a source with no characters has no
weight, its rate is 1. An empty table gives an empty result. Other columns pass through; the names of added columns
get an underscore in front where they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import body, cut, documents, free_name

SEED = 17
#: Weights where none are given: characters to this power, normalised (1: as they come, 0: all sources equal).
TEMPERATURE = 0.5

#: Numbers of all rates that a task may hold (8 MB), and keys that a source's rows are dealt over where there are more.
HELD, SALTS = 1 << 20, 16


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, chars, rate, below, cdf) per source: ``cdf`` holds P(X <= k) for k from ``below``. ``budget``: characters wanted, as a multiple of those there."""
    sizes = cut(docs.groupBy("source").agg(F.sum(F.length(body())).cast("double").alias("chars")))
    if weights is None:
        raw = F.pow("chars", F.lit(float(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        raw = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("raw", raw)
    chars, raws = sizes.agg(F.sum("chars"), F.sum("raw")).first()
    rated = sizes.withColumn("rate", F.coalesce(F.try_divide(F.col("raw") * F.lit(budget * (chars or 0.0)), F.lit(raws or 0.0) * F.col("chars")), F.lit(1.0)))
    # P(X < below) and P(X > last) are far below 2^-52, the step of the uniform numbers
    below = F.greatest(F.lit(0), F.floor(F.col("rate") - 12 * F.sqrt("rate"))).cast("int")
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    # terms relative to the one at ``below``, divided by their sum: exp(-rate) would be 0 from a rate of 746 on
    steps = F.aggregate(
        F.sequence(below + 1, last),
        F.struct(F.lit(1.0).alias("p"), F.array(F.lit(1.0)).alias("cdf")),
        lambda s, k: F.struct((s["p"] * F.col("rate") / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * F.col("rate") / k)).alias("cdf")),
        lambda s: F.transform(s["cdf"], lambda c: c / F.element_at(s["cdf"], -1)))
    return rated.select("source", "chars", "rate", below.alias("below"), steps.alias("cdf"))


def _measured(rates: DataFrame, cdf: str) -> tuple[DataFrame, int]:
    """The rates, written, and how many numbers they are."""
    rates = cut(rates)
    return rates, rates.agg(F.sum(F.size(cdf) + 3)).first()[0] or 0


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED,
        copy: str = "copy", key: str = "shuffle_key") -> DataFrame:
    """The documents, each as often as it drew, in hashed order, with the number of the copy (from 1) and the order's key."""
    own = docs.columns
    source, below, cdf = free_name("source_of_rate", own), free_name("below", own), free_name("cdf", own)
    copy, key = free_name(copy, own), free_name(key, own)
    rates = repetition_rates(docs, weights, budget, temperature).select(F.col("source").alias(source), F.col("below").alias(below), F.col("cdf").alias(cdf))
    rates, size = _measured(rates, cdf)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = uniform(F.concat(F.lit(f"{seed}:"), name))
    if size <= HELD:  # texts stay where they are
        rated = docs.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col(source)))
    else:  # more sources than a task should hold: each source's rows are dealt over several keys
        salt = free_name("salt", own)
        spread = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id", body()), F.lit(SALTS)).cast("int"))
        rated = salted.join(spread, F.col("source").eqNullSafe(F.col(source)) & (salted[salt] == spread[salt])).drop(salted[salt], spread[salt])
    times = F.col(below) + F.size(F.filter(F.col(cdf), lambda c: c <= drawn))
    copies = rated.withColumn(copy, times).where(F.col(copy) > 0).select(*own, F.explode(F.sequence(F.lit(1), F.col(copy))).alias(copy))
    copies = copies.withColumn(key, F.md5(F.concat_ws(":", F.lit(f"{seed}"), name, F.col(copy).cast("string"))))
    return copies.repartitionByRange(key).sortWithinPartitions(key)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text"))


ORACLE = f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
rates AS (SELECT source, coalesce(pow(chars, {TEMPERATURE}) * sum(chars) OVER () / nullif(sum(pow(chars, {TEMPERATURE})) OVER () * chars, 0), 1.0) AS rate FROM sizes),
steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates),
terms AS (SELECT source, k, exp(-rate) * pow(rate, k) / gamma(k + 1) AS p FROM steps),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT doc_id, source, text, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents),
counts AS (SELECT d.doc_id, d.source, d.text, count(*) FILTER (WHERE c.c <= d.u) AS n
           FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id, d.source, d.text),
copies AS (SELECT doc_id, source, text, unnest(range(1, n + 1))::INTEGER AS copy FROM counts WHERE n > 0)
SELECT doc_id, source, text, copy, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS shuffle_key FROM copies"""
