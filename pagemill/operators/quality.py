"""Quality flags per page, their statistics, badges, bands and the flag table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import quads
from pagemill.functions.numbers import ratio
from pagemill.operators.quantiles import exact_median, positions
from pagemill.params import Params

# Crop states that mean "no page outline found".
NO_QUAD = ("no_detection", "invalid_geometry", "no_valid_detection")
MARGINS = [f"margin_{e}" for e in quads.EDGES]
WARNINGS = ["low_confidence_orientation", "overcrop_risk", "no_quad_detected", "low_contrast_after_enhance", "too_small_final"]


def crop_margins(pages: DataFrame) -> DataFrame:
    """Margins per edge in percent: from the source points, else estimated from the sizes."""
    known = F.col("source_points").isNotNull()
    margins = F.when(known, quads.edge_margins(F.col("source_points"), F.col("width"), F.col("height"))).otherwise(
        quads.centred_margins(F.col("width"), F.col("height"), F.col("final_width"), F.col("final_height")))
    boxed = pages.withColumn("_m", margins)
    return boxed.withColumns({f"margin_{e}": F.col("_m")[e] for e in quads.EDGES}).drop("_m")


def quality_flags(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """Seven flags per page. ``rotated`` also holds for a rejected rotation, whose angle stays in the log;
    ``rotation_applied`` tells the two apart."""
    confidence = F.coalesce("orientation_confidence", F.lit(0.0))
    angle = F.coalesce("orientation_angle", F.lit(0.0))
    needed = F.abs(angle) > p.rotation_epsilon
    applied = needed & (confidence >= p.orientation_min_confidence)
    logged = F.coalesce("logged_angle", F.lit(0.0)) if "logged_angle" in pages.columns else angle
    cropped = F.col("crop_status") == "cropped"
    thin = reduce(lambda a, b: a | b, [F.col(m) < p.crop_min_margin_ratio * 100 for m in MARGINS])
    capture = F.coalesce("capture_type", F.lit("UNKNOWN"))
    return pages.withColumns({
        "low_confidence_orientation": confidence < p.orientation_min_confidence,
        "overcrop_risk": F.coalesce(cropped & thin, F.lit(False)),
        "no_quad_detected": F.coalesce(F.col("crop_status").isin(*NO_QUAD), F.lit(False)),
        "dewarp_applied": F.coalesce(cropped & F.col("has_matrix"), F.lit(False)),
        "low_contrast_after_enhance": F.col("contrast") < p.min_contrast,
        "too_small_final": (F.col("final_width") < p.min_width) | (F.col("final_height") < p.min_height),
        "rotation_applied": applied,
        "rotated": applied | (F.abs(logged) > p.rotation_epsilon),
        "crop_margins": F.when(cropped, F.create_map(*[c for e in quads.EDGES for c in (F.lit(e), F.col(f"margin_{e}"))])),
        "orientation_confidence": confidence,
        "capture_type": capture,
        "white_fraction": F.coalesce("white_fraction", F.lit(0.0)),
    })


def _any(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(n), F.lit(False)) for n in names])


def flag_statistics(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates and counts over the kept pages; no row for no pages. Times are averaged over all pages."""
    total = F.count(F.lit(1))
    return flags.groupBy(*(by or [])).agg(
        total.alias("pages"),
        ratio(F.count_if(~F.col("low_confidence_orientation")), total).alias("orientation_accuracy"),
        F.count_if("overcrop_risk").alias("overcrop_risk_count"),
        ratio(F.count_if("overcrop_risk"), total).alias("overcrop_risk_rate"),
        F.count_if("no_quad_detected").alias("no_quad_detected_count"),
        ratio(F.count_if("no_quad_detected"), total).alias("no_quad_detected_rate"),
        F.count_if("dewarp_applied").alias("dewarp_applied_count"),
        F.count_if("low_contrast_after_enhance").alias("low_contrast_count"),
        F.count_if("too_small_final").alias("too_small_count"),
        ratio(F.sum(F.coalesce("processing_time", F.lit(0.0))), total).alias("avg_processing_time"),
        F.count_if(_any(WARNINGS + ["dewarp_applied"])).alias("pages_with_flags"),
    ).where("pages > 0")


def report_statistics(flags: DataFrame, by: list[str] | None = None, p: Params = Params()) -> DataFrame:
    """Figures of the quality report. Times count only above 0; an empty table gives one row of zeros."""
    by = by or []
    timed = F.when(F.col("processing_time") > 0, F.col("processing_time"))
    steady = F.when(F.col("deskew_confidence") > 0, F.col("deskew_confidence"))
    zero = F.lit(0.0)
    angle = F.abs(F.coalesce("deskew_angle", zero))
    figures = flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        ratio(F.count_if(~F.col("low_confidence_orientation")), F.count(F.lit(1))).alias("orientation_accuracy"),
        F.count_if("overcrop_risk").alias("overcrop_risk_count"),
        ratio(F.count_if("no_quad_detected"), F.count(F.lit(1))).alias("no_quad_rate"),
        F.coalesce(F.avg(timed), zero).alias("avg_time"),
        F.coalesce(F.min(timed), zero).alias("min_time"),
        F.coalesce(F.max(timed), zero).alias("max_time"),
        F.coalesce(F.avg(angle), zero).alias("avg_deskew_angle"),
        F.coalesce(F.avg(steady), zero).alias("avg_deskew_confidence"),
        F.count_if(_any(WARNINGS)).alias("pages_with_warnings"),
        F.count_if(F.col("capture_type") == "SCAN").alias("scan_count"),
        F.count_if(F.col("capture_type") == "PHOTO").alias("photo_count"),
        F.count_if("rotated").alias("rotations_applied"),
        F.count_if(angle >= p.deskew_shown_angle).alias("deskews_applied"),
        F.count_if("dewarp_applied").alias("crops_applied"),
    )
    medians = exact_median(flags.where("processing_time > 0"), by, "processing_time")
    if by:
        figures = figures.join(medians, by, "left").withColumn("median_time", F.coalesce("median", zero)).drop("median")
    else:
        figures = figures.withColumn("median_time", F.coalesce(medians.select("median").scalar(), zero))
    return figures.withColumns({
        "time_spread": F.col("max_time") - F.col("min_time"),
        "mean_median_gap": F.abs(F.col("avg_time") - F.col("median_time")),
    })


def time_warnings(statistics: DataFrame, p: Params = Params()) -> DataFrame:
    """Gap of mean and median in percent of the median, and what it suggests."""
    percent = F.when(F.col("median_time") > 0, F.abs(F.col("avg_time") - F.col("median_time")) / F.col("median_time") * 100)
    warning = F.when(F.col("gap_percent") > p.outlier_percent, "outliers").when(F.col("gap_percent") > p.skewed_percent, "asymmetric")
    return statistics.withColumn("gap_percent", percent).withColumn("time_warning", warning)


def badge_columns() -> dict[str, Column]:
    """State per concern: applied, skipped, info, inactive or warning."""

    def flag(name: str, state: str) -> Column:
        return F.when(F.col(name), state).otherwise("inactive")

    return {
        "Rotation": flag("rotated", "applied"),
        "Deskew": F.when(F.col("deskew_status").isin("success", "applied"), "applied")
        .when(F.col("deskew_status").isin("low_confidence", "angle_too_small", "skipped_low_confidence", "skipped_small_angle"), "skipped")
        .otherwise("inactive"),
        "Crop": F.when(F.col("crop_status") == "cropped", "applied")
        .when(F.col("crop_status").isin("already_cropped", "skipped_scan"), "skipped").otherwise("inactive"),
        "Dewarp": flag("dewarp_applied", "applied"),
        "Capture Type": F.when(F.col("capture_type").isin("SCAN", "PHOTO"), "info").otherwise("inactive"),
        "Low Conf": flag("low_confidence_orientation", "warning"),
        "Overcrop": flag("overcrop_risk", "warning"),
        "No Quad": flag("no_quad_detected", "warning"),
        "Low Contrast": flag("low_contrast_after_enhance", "warning"),
        "Too Small": flag("too_small_final", "warning"),
    }


def badges(flags: DataFrame, keys: list[str]) -> DataFrame:
    """(page, badge, state): ten rows per page."""
    wide = flags.select(*keys, *[state.alias(name) for name, state in badge_columns().items()])
    return wide.unpivot(keys, list(badge_columns()), "badge", "state")


def confidence_bands(flags: DataFrame, p: Params = Params()) -> DataFrame:
    o, d = F.coalesce("orientation_confidence", F.lit(0.0)), F.coalesce("deskew_confidence", F.lit(0.0))
    return flags.withColumns({
        "orientation_band": F.when(o >= p.orientation_good, "good").when(o > 0, "bad").otherwise("n/a"),
        "deskew_band": F.when(d >= p.deskew_good, "good").when(d >= p.deskew_fair, "fair").when(d > 0, "poor").otherwise("n/a"),
    })


def sort_key(column: str, kind: str) -> Column:
    """Key of a flag-table column: unshown confidences sort as -1, flags as 1/0, the rest by value or lower case."""
    if kind == "confidence":
        return F.when(F.col(column) > 0, F.col(column)).otherwise(-1.0)
    if kind == "flag":
        return F.when(F.col(column), 1).otherwise(0)
    if kind == "text":
        return F.lower(column)
    return F.col(column)


def flag_table(flags: DataFrame, column: str, kind: str = "number", ascending: bool = True, ties: list[str] | None = None) -> DataFrame:
    key = sort_key(column, kind)
    return flags.orderBy(key.asc() if ascending else key.desc(), *(ties or []))


def report_positions(flags: DataFrame, order: list[Column]) -> DataFrame:
    """1-based place of every page in the report."""
    return positions(flags, order, name="_p").withColumn("position", F.col("_p") + 1).drop("_p")


def report_page(flags: DataFrame, order: list[Column], start: int = 0, size: int = 10) -> DataFrame:
    """One screen of the report: a top-k over the order, not a full sort."""
    return flags.orderBy(*order).offset(start).limit(size)


def sidecar_pages(flags: DataFrame, images: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Pages whose image exists (.png, else .jpg), with their transform log where there is one.

    ``flags`` has ``path`` of the sidecar; ``images`` and ``logs`` have ``path``.
    """
    base = F.regexp_replace("path", r"\.qa\.json$", "")
    found = images.select(
        F.regexp_replace("path", r"\.(png|jpg)$", "").alias("base"),
        F.regexp_extract("path", r"\.(png|jpg)$", 1).alias("ext"), F.col("path").alias("image_path"),
    ).where("ext <> ''")
    best = found.groupBy("base").agg(
        F.coalesce(F.max(F.when(F.col("ext") == "png", F.col("image_path"))), F.max("image_path")).alias("image_path"))
    kept = flags.withColumn("base", base).join(best, "base")
    if logs is not None:
        logged = logs.select(F.regexp_replace("path", r"\.transform\.json$", "").alias("base"), F.col("transforms"))
        kept = kept.join(logged, "base", "left")
    return kept.withColumn("page_name", F.regexp_extract("base", r"([^/]*)$", 1)).drop("base")
