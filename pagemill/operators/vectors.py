"""Line vectors to document vectors."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pagemill.functions.frames import once
from pagemill.operators.lines import BOX, PAGE, confident_lines, extent_columns
from pagemill.params import Params

METHODS = ("weighted_mean", "mean", "max", "sum")


def _fold(vectors: DataFrame, keys: list[str], vector: str, dim: int, method: str, weight: str | None) -> DataFrame:
    weighted = method == "weighted_mean" and weight is not None
    w = F.col(weight).cast("float").cast("double") if weighted else F.lit(1.0)
    value = [F.get(vector, F.lit(i)) for i in range(dim)]
    if method == "max":
        aggs = [F.max(v).alias(f"_{i}") for i, v in enumerate(value)]
    else:
        aggs = [F.sum(w * v).alias(f"_{i}") for i, v in enumerate(value)]
    folded = vectors.groupBy(*keys).agg(*aggs, F.sum(w).alias("_w"))
    scale = F.col("_w") if method in ("weighted_mean", "mean") else F.lit(1.0)
    parts = [F.try_divide(F.col(f"_{i}"), scale).cast("float") for i in range(dim)]
    return folded.select(*keys, F.array(*parts).alias("vector"))


def aggregate_vectors(vectors: DataFrame, keys: list[str], dim: int, method: str = "weighted_mean",
                      vector: str = "vector", weight: str | None = "confidence") -> DataFrame:
    """One vector per key. Without a weight column the weighted mean is the plain mean.

    One sum per dimension, pre-aggregated before the shuffle, so a key that holds a third of all lines costs
    one partial row per input partition. Every width is treated alike: a null element is skipped, and a weight
    of zero gives null elements.
    """
    if method not in METHODS:
        raise ValueError(f"unknown aggregation {method!r}, expected one of {METHODS}")
    return _fold(vectors, keys, vector, dim, method, weight)


def explode_aggregate(vectors: DataFrame, keys: list[str], vector: str = "vector", weight: str = "confidence") -> DataFrame:
    """Weighted mean in long form (key, dim, value): the cross-check of ``aggregate_vectors``."""
    w = F.col(weight).cast("float").cast("double")
    long = vectors.select(*keys, w.alias("_w"), F.posexplode(vector).alias("dim", "_v"))
    sums = long.groupBy(*keys, "dim").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_w"))
    return sums.select(*keys, "dim", F.try_divide("_s", "_w").alias("value"))


def line_features(lines: DataFrame, semantic: str = "semantic") -> DataFrame:
    """Semantic vector followed by the four positions."""
    shares = F.array(*[F.col(f"{b}_share").cast("double") for b in BOX])
    return lines.withColumn("vector", F.concat(F.col(semantic).cast("array<double>"), shares))


def document_vectors(lines: DataFrame, documents: DataFrame, semantic_dim: int, p: Params = Params(),
                     keys: list[str] = PAGE, semantic: str = "semantic") -> DataFrame:
    """Confidence-weighted vector per page from raw lines; the zero vector for a page without usable lines.

    Positions are shares of the page extent, which is constant per page, so the sums of weighted raw
    coordinates and the page maxima come out of one aggregation and are divided afterwards: no join of
    lines back to their page, and a huge page is pre-aggregated like any other.
    """
    w = F.col("confidence").cast("float").cast("double")
    value = [F.get(semantic, F.lit(i)) for i in range(semantic_dim)]
    sums = [F.sum(w * v).alias(f"_{i}") for i, v in enumerate(value)]
    boxes = [F.sum(w * F.col(b)).alias(f"_{b}") for b in BOX]
    folded = confident_lines(lines, p).groupBy(*keys).agg(
        *sums, *boxes, F.sum(w).alias("_w"),
        F.max(F.greatest("x1", "x2")).alias("max_x"), F.max(F.greatest("y1", "y2")).alias("max_y"),
    )
    sized = folded.select("*", *extent_columns(F.col("max_x"), F.col("max_y"), p))
    parts = [F.try_divide(f"_{i}", "_w").cast("float") for i in range(semantic_dim)]
    for b in BOX:
        size = F.col("page_width" if b[0] == "x" else "page_height")
        parts.append(F.when(size > 0, F.try_divide(f"_{b}", "_w") / size).otherwise(0.0).cast("float"))
    vectors = sized.select(*keys, F.array(*parts).alias("vector"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), semantic_dim + len(BOX))
    return documents.join(vectors, keys, "left").withColumn("vector", F.coalesce("vector", zeros))


def token_dims(text: Column, dim: int) -> Column:
    """The dimension of each token (lower case, between blanks): the first digits of its MD5."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim)


def unit(vector: Column) -> Column:
    """The vector at length 1; one of zeros stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(norm > 0, F.transform(vector, lambda v: v / norm)).otherwise(vector)


def hashed_encoder(lines: DataFrame, dim: int = 64, text: str = "text", output: str = "semantic") -> DataFrame:
    """Default text encoding: hashed token counts of unit length, computed in the JVM without a model file."""
    held = once(lines, {"_dims": token_dims(F.col(text), dim)})
    counted = once(held, {"_raw": F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter("_dims", lambda x: x == d)).cast("double"))})
    return counted.withColumn(output, unit(F.col("_raw"))).drop("_dims", "_raw")


def hashed_model(dim: int = 64):
    """The hashed encoder as a model for ``encode_with``."""
    def load():
        def encode(texts: list[str]) -> list[list[float]]:
            out = np.zeros((len(texts), dim))
            for row, text in zip(out, texts):
                for token in text.lower().split():
                    row[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
            return out.tolist()
        return encode
    return load


def encode_with(lines: DataFrame, load_model, text: str = "text", output: str = "semantic", batch: int = 256) -> DataFrame:
    """Encode text with an external model: ``load_model()`` runs once in a Python worker and returns a function from a
    list of texts to a list of vectors, which gets ``batch`` texts at a time. Vectors are scaled to unit length afterwards."""
    def load():
        model = load_model()
        return lambda texts: np.array([list(map(float, v)) for v in model([t or "" for t in texts.tolist()])])

    encode = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch)
    encoded = lines.withColumn("_raw", encode(F.coalesce(F.col(text), F.lit(""))))
    return encoded.withColumn(output, unit(F.col("_raw"))).drop("_raw")
