"""Geometry decisions per page: orientation, crop, deskew, rotation, sizes, skew from line angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import quads
from pagemill.functions.frames import once
from pagemill.functions.numbers import clamp, first_max_index, ratio, softmax, whole
from pagemill.operators.quantiles import beside, counted, narrowed_medians, split, with_medians
from pagemill.params import Params

RIGHT_ANGLES = (0, 90, 180, 270)


def right_angle(angle: Column) -> Column:
    """Floor-mod 360, then the closest of the four right angles on the line (no wrap: 350 goes to 270)."""
    turned = F.pmod(angle, F.lit(360))
    return F.when(turned <= 45, 0).when(turned <= 135, 90).when(turned <= 225, 180).otherwise(270)


def normalise_orientation(pages: DataFrame, angle: str = "raw_angle", confidence: str = "raw_confidence") -> DataFrame:
    return (
        pages.withColumn("orientation_angle", right_angle(F.col(angle)))
        .withColumn("orientation_confidence", clamp(F.col(confidence), 0.0, 1.0))
        .withColumn("needs_rotation", F.col("orientation_angle") != 0)
    )


def class_probabilities(scores: Column) -> Column:
    """Softmax when any score lies outside [0, 1], else shares of the sum (as they are when it is 0)."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, b: a + b)
    logits = F.exists(scores, lambda s: (s < 0) | (s > 1))
    return F.when(logits, softmax(scores)).when(total > 0, F.transform(scores, lambda s: s / total)).otherwise(scores)


def orientation_from_scores(pages: DataFrame, scores: str = "scores") -> DataFrame:
    """Four class scores to angle and confidence; any other count is left unprocessed (0 degrees, 1.0)."""
    judged = pages.withColumn("probabilities", class_probabilities(F.col(scores)))
    usable = F.coalesce(F.size(scores) == 4, F.lit(False))
    index = first_max_index(F.col("probabilities"))
    return judged.select(
        *[c for c in pages.columns],
        F.when(usable, index * 90).otherwise(F.lit(0)).cast("bigint").alias("angle"),
        F.when(usable, F.array_max("probabilities")).otherwise(1.0).alias("confidence"),
        usable.alias("processed"),
    )


def crop_decisions(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """Crop status, area share, margins, ordered source points and output size per page.

    Expects corners (null or empty: nothing detected), capture_type, width and height.
    """
    width, height = F.col("width"), F.col("height")
    count = F.size("corners")
    # Lists of more than four points only need their area; they cannot be straightened.
    many = (count > 4) & quads.all_points(F.col("corners"))
    polygons = pages.withColumn("_polygon", F.when(many, quads.area(quads.scaled(F.col("corners"), width, height))))
    placed = quads.corner_indices(quads.four_points(polygons, "corners", (width, height)))
    xs, ys = [F.col(f"_x{i}") for i in range(4)], [F.col(f"_y{i}") for i in range(4)]
    page_area = (width * height).cast("double")
    # Margins come from the box of the points, which does not depend on their order.
    measured = once(placed, {
        "_share": F.try_divide(F.coalesce(quads.quad_area(), F.col("_polygon")), page_area),
        "_margins": F.when(F.col("_tl").isNotNull(), quads.margins_of(xs, ys, width, height)),
    })
    status = (
        F.when(F.lit(not p.crop_enabled), "skipped")
        .when((F.col("capture_type") == "SCAN") & F.lit(p.skip_crop_if_scan), "skipped_scan")
        .when(F.col("corners").isNull() | (count == 0), "no_detection")
        .when(count < 4, "invalid_geometry")
        .when(F.col("_share").isNull(), "error")
        .when(F.col("_share") > p.crop_max_area_ratio, "already_cropped")
        .when(F.col("_tl").isNull(), "error")
        .when(quads.smallest(F.col("_margins")) < p.crop_min_margin_ratio * 100, "rejected_overcrop")
        .otherwise("cropped")
    )
    decided = once(measured, {"crop_status": status, "_quad": quads.ordered()})
    state = F.col("crop_status")
    applied = state == "cropped"
    judged = state.isin("already_cropped", "rejected_overcrop", "cropped", "error") & F.col("_share").isNotNull()
    return decided.withColumns({
        "crop_applied": applied,
        "area_ratio": F.when(judged, F.col("_share")).otherwise(1.0),
        "margins": F.when(state.isin("rejected_overcrop", "cropped"), F.col("_margins")),
        "source_points": F.when(applied, F.col("_quad")),
        "output_size": F.when(applied, quads.output_size(F.col("_quad"))),
    }).drop("_polygon", "_quad", "_share", "_margins", *quads.POINT_COLUMNS)


def deskew_decisions(pages: DataFrame, p: Params = Params(), called: bool = False) -> DataFrame:
    """Deskew status from the estimated angle and confidence.

    A page run skips disabled or tiny corrections before the call; ``called=True`` judges the call itself.
    """
    size = F.abs("skew_angle")
    off = F.lit(not p.deskew_enabled)
    status = (
        F.when(off if called else off | (size < p.deskew_call_angle), "disabled" if called else "skipped")
        .when(size < p.deskew_min_angle, "angle_too_small")
        .when(F.col("skew_confidence") < p.deskew_min_confidence, "low_confidence")
        .otherwise("success")
    )
    return pages.withColumn("deskew_status", status).withColumn("deskew_applied", F.col("deskew_status") == "success")


def rotation_matrix(angle: Column, centre_x: Column, centre_y: Column) -> Column:
    """2x3 matrix of a rotation about a centre, degrees counter-clockwise, y axis down."""
    a, b = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.array(
        F.array(a, b, (1 - a) * centre_x - b * centre_y),
        F.array(-b, a, b * centre_x + (1 - a) * centre_y),
    )


def deskew_canvas(pages: DataFrame, angle: str = "skew_angle") -> DataFrame:
    """Canvas that holds the whole turned page, and the matrix shifted to its centre."""
    a, b = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    w, h = F.col("width"), F.col("height")
    centre_x, centre_y = F.expr("width div 2"), F.expr("height div 2")
    new_width = whole(h * F.abs(b) + w * F.abs(a))
    new_height = whole(h * F.abs(a) + w * F.abs(b))
    turned = rotation_matrix(F.col(angle), centre_x, centre_y)

    def row(i: int, shift: Column) -> Column:
        return F.array(turned[i][0], turned[i][1], turned[i][2] + shift)

    return pages.withColumns({"canvas_width": new_width, "canvas_height": new_height}).withColumn(
        "matrix", F.array(row(0, F.col("canvas_width") / 2 - centre_x), row(1, F.col("canvas_height") / 2 - centre_y))
    )


def rotation_decisions(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """Applied angle and log entry of the final rotation; a rejected one stays in the log with its angle."""
    unsure = F.col("orientation_confidence") < p.orientation_min_confidence
    status = F.when(~F.col("needs_rotation"), F.lit(None)).when(unsure, "rejected").otherwise("applied")
    return pages.withColumn("rotation_status", status).withColumns({
        "rotation_applied": F.coalesce(F.col("rotation_status") == "applied", F.lit(False)),
        "applied_angle": F.when(F.col("rotation_status") == "applied", F.col("orientation_angle")).otherwise(0),
        "logged_angle": F.when(F.col("rotation_status").isNotNull(), F.col("orientation_angle")),
    })


def read_sizes(pages: DataFrame, dpi: str, p: Params = Params()) -> DataFrame:
    """Effective scan resolution, and the size after shrinking the longer side to the limit."""
    longest = F.greatest("width", "height")
    scale = F.when(longest > p.lines_max_side, F.lit(float(p.lines_max_side)) / longest)

    def shrunk(side: str) -> Column:
        return F.coalesce(whole(F.col(side) * scale), F.col(side))

    return pages.withColumns({
        "effective_dpi": F.greatest(F.col(dpi), F.lit(p.min_dpi)),
        "read_width": shrunk("width"),
        "read_height": shrunk("height"),
    })


def skew_estimates(line_angles: DataFrame, pages: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """Median line angle per page and the share of lines within the tolerance of it.

    Lines are counted per (page, angle). A page of few angles is sorted once, and its median and the lines near it are taken
    from the sorted counts; for others the median is selected first and joined to the counts. So a page may have any number
    of lines and of different angles. Pages without any line (taken from ``pages``) get (0, 0).
    """
    angle = F.col("theta") - 90
    folded = F.when(angle < -45, angle + 90).when(angle > 45, angle - 90).otherwise(angle)
    key = ["page_key"]
    few, many = split(counted(line_angles.select(*key, folded.alias("angle")), key, "angle"), key)
    near = F.sum(F.when(F.abs(F.col("_v") - F.col("median")) <= p.deskew_tolerance, F.col("_n")).otherwise(0))
    page = Window.partitionBy(*key)
    grouped = with_medians(few, key).withColumn("inliers", near.over(page)).where("_place = 1").select(
        *key, "median", "inliers", F.col("_total").alias("lines"))
    if many is not None:
        crowded = beside(many, narrowed_medians(many, key), key).groupBy(*key, "median").agg(near.alias("inliers"), F.sum("_n").alias("lines"))
        grouped = grouped.unionByName(crowded)
    usable = F.abs("median") <= p.deskew_max_angle
    estimates = grouped.select(
        "page_key",
        F.when(usable, F.col("median")).otherwise(0.0).alias("skew_angle"),
        F.when(usable, ratio(F.col("inliers"), F.col("lines"))).otherwise(0.0).alias("skew_confidence"),
        "lines",
    )
    if pages is None:
        return estimates
    return pages.select("page_key").distinct().join(estimates, "page_key", "left").na.fill(0)


def with_preprocessing(pages: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Attach the preprocessing record; without one the page is a PHOTO at its own path."""
    return pages.join(sidecars, "path", "left").withColumns({
        "capture_type": F.coalesce("capture_type", F.lit("PHOTO")),
        "original_path": F.coalesce("original_path", "path"),
    })
