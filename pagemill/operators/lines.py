"""Text lines: confidence filter, boxes, page extents, positions, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import quads
from pagemill.functions.numbers import whole
from pagemill.params import Params

PAGE = ["doc_id", "page_index"]
BOX = ["x1", "y1", "x2", "y2"]


def confident_lines(lines: DataFrame, p: Params = Params()) -> DataFrame:
    """Lines at or above the threshold; a missing confidence counts as 0."""
    return lines.where(F.coalesce("confidence", F.lit(0.0)) >= p.line_min_confidence)


def canonical_boxes(lines: DataFrame) -> DataFrame:
    """[x1, y1, x2, y2] from a plain rectangle (``box``) or a point list (``corners``).

    Malformed lists become the zero box; a line without any box keeps null.
    """
    zero = F.array(*[F.lit(0.0)] * 4)
    usable = (F.size("corners") > 0) & quads.all_points(F.col("corners"))
    box = (
        F.when(F.size("box") == 4, F.col("box"))
        .when(usable, quads.bounding_box(F.col("corners")))
        .when(F.col("box").isNotNull() | F.col("corners").isNotNull(), zero)
    )
    return lines.withColumn("rect", box)


def extent_columns(max_x: Column, max_y: Column, p: Params = Params()) -> list[Column]:
    def extent(top: Column) -> Column:
        return F.when(top > 0, whole(top * p.extent_margin)).otherwise(F.lit(p.extent_default).cast("bigint"))

    return [extent(max_x).alias("page_width"), extent(max_y).alias("page_height")]


def page_extents(lines: DataFrame, p: Params = Params(), keys: list[str] = PAGE,
                 width: int | None = None, height: int | None = None) -> DataFrame:
    """Page size per page: the given pair, else the largest coordinate plus a margin."""
    if width is not None and height is not None:
        return lines.select(*keys).distinct().select(
            *keys, F.lit(width).cast("bigint").alias("page_width"), F.lit(height).cast("bigint").alias("page_height"))
    tops = lines.groupBy(*keys).agg(
        F.max(F.greatest("x1", "x2")).alias("max_x"), F.max(F.greatest("y1", "y2")).alias("max_y")
    )
    return tops.select(*keys, *extent_columns(F.col("max_x"), F.col("max_y"), p))


def positions(lines: DataFrame, extents: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Box coordinates as float32 shares of the page; 0 when the extent is not positive.

    The extents hold one row per page: small enough to be broadcast, or shuffled on the page key with
    skewed pages split by AQE (the line side of the inner join may be split freely).
    """
    sized = lines.join(extents, keys)
    for name in BOX:
        size = F.col("page_width" if name[0] == "x" else "page_height")
        share = F.when(size > 0, F.col(name) / size).otherwise(0.0).cast("float")
        sized = sized.withColumn(f"{name}_share", share)
    return sized


def word_extents(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Rectangle around all word boxes of a page, as four corners clockwise from top-left."""
    box = lines.groupBy(*keys).agg(
        F.min("x1").alias("x_min"), F.min("y1").alias("y_min"), F.max("x2").alias("x_max"), F.max("y2").alias("y_max")
    )
    corners = F.array(
        F.array("x_min", "y_min"), F.array("x_max", "y_min"), F.array("x_max", "y_max"), F.array("x_min", "y_max")
    )
    return box.withColumn("corners", corners)


def line_problem(p: Params = Params()) -> Column:
    """Name of the first broken rule of a line record, or null."""
    return (
        F.when(F.col("text").isNull(), "text_missing")
        .when(F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence_range")
        .when(F.coalesce(F.size("rect"), F.lit(-1)) != 4, "box_shape")
        .when(F.exists("rect", lambda v: v.isNull()), "box_shape")
        .when(F.col("processing_time") < 0, "negative_time")
    )


def checked_lines(lines: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Split into valid lines and rejects with the reason."""
    judged = lines.withColumn("problem", line_problem(p))
    return judged.where("problem IS NULL").drop("problem"), judged.where("problem IS NOT NULL")
