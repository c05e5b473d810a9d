"""Capture type, white share and contrast, from luma lists, luma counts or decoded images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.numbers import ratio
from pagemill.params import Params


def white_share(luma: Column, p: Params = Params()) -> Column:
    return ratio(F.size(F.filter(luma, lambda v: v > p.white_level)), F.size(luma))


def capture_types(pages: DataFrame, p: Params = Params(), share: str = "white_fraction", error: str | None = None) -> DataFrame:
    """SCAN when the white share is above the threshold, else PHOTO; failed pages are PHOTO with their error."""
    failed = F.col(error).isNotNull() if error else F.lit(False)
    off = F.lit(not p.capture_enabled)
    distance = F.abs(F.col(share) - p.white_fraction) * 2
    return pages.withColumns({
        "capture_type": F.when(off | failed, "PHOTO").when(F.col(share) > p.white_fraction, "SCAN").otherwise("PHOTO"),
        "capture_confidence": F.when(off | failed, 0.0).otherwise(F.least(F.lit(1.0), distance)),
        "capture_white": F.when(off | failed, 0.0).otherwise(F.col(share)),
        "capture_enabled": ~off,
    })


def luma_counts(pages: DataFrame, key: str = "page_key", luma: str = "luma") -> DataFrame:
    """(page, luma value, pixels): at most 256 rows per page after counting."""
    return pages.select(key, F.explode(luma).alias("value")).groupBy(key, "value").agg(F.count(F.lit(1)).alias("pixels"))


def white_shares(counts: DataFrame, key: str = "page_key", p: Params = Params()) -> DataFrame:
    white = F.sum(F.when(F.col("value") > p.white_level, F.col("pixels")).otherwise(0))
    return counts.groupBy(key).agg(ratio(white, F.sum("pixels")).alias("white_fraction"))


def contrasts(counts: DataFrame, key: str = "page_key") -> DataFrame:
    """Population standard deviation of luma, from exact integer sums."""
    sums = counts.groupBy(key).agg(
        F.sum("pixels").alias("n"),
        F.sum(F.col("pixels") * F.col("value")).alias("s"),
        F.sum(F.col("pixels") * F.col("value") * F.col("value")).alias("q"),
    )
    mean = F.col("s") / F.col("n")
    return sums.select(key, F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("contrast"))


# Luma weights of red, green, blue.
LUMA = (0.299, 0.587, 0.114)


def _histogram(data: bytes, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, dtype=np.uint8)
    if channels >= 3:
        bgr = pixels.reshape(-1, channels)[:, :3].astype(np.float64)
        gray = np.rint(bgr @ np.array(LUMA[::-1])).astype(np.int64)
    else:
        gray = pixels.astype(np.int64)
    return np.bincount(np.clip(gray, 0, 255), minlength=256)


def image_histograms(images: DataFrame) -> DataFrame:
    """Luma histogram (256 counts) per image of Spark's ``image`` source; the JVM decodes, NumPy counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_histogram(d, c) for d, c in zip(batch["data"], batch["channels"])]
            yield pd.DataFrame({
                "path": batch["path"], "width": batch["width"], "height": batch["height"],
                "histogram": [r.tolist() for r in rows],
            })

    flat = images.select(
        F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )
    return flat.mapInPandas(count, "path string, width int, height int, histogram array<bigint>")


def histogram_counts(histograms: DataFrame, key: str = "path") -> DataFrame:
    return histograms.select(key, F.posexplode("histogram").alias("value", "pixels")).where("pixels > 0")
