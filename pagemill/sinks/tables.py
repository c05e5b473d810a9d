"""Sinks: per-page JSON records, labelled data sets, the global metadata document, expiring results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, VariantType

from pagemill.operators.quality import flag_statistics
from pagemill.operators.transforms import sorted_transforms

FLAG_FIELDS = [
    "low_confidence_orientation", "overcrop_risk", "no_quad_detected", "dewarp_applied", "low_contrast_after_enhance",
    "too_small_final", "rotated", "orientation_confidence", "orientation_angle", "deskew_angle", "deskew_confidence",
]


def flag_record() -> Column:
    """One page's flags; unknown margins are {} and an unknown resolution is []."""
    margins = F.coalesce("crop_margins", F.create_map().cast("map<string,double>")).alias("crop_margins")
    size = F.when(F.col("final_width").isNotNull(), F.array(F.col("final_width").cast("bigint"), F.col("final_height").cast("bigint")))
    resolution = F.coalesce(size, F.array().cast("array<bigint>")).alias("final_resolution")
    return F.struct(
        *FLAG_FIELDS, margins, resolution, "processing_time", "capture_type",
        F.col("white_fraction").alias("capture_white_percentage"))


def features_record() -> Column:
    """One page's lines and check boxes (arrays of structs); a page without any has empty lists, a box or text that is missing its default."""
    box = lambda b: F.coalesce(b, F.array(*[F.lit(0.0)] * 4))
    lines = F.transform("ocr_lines", lambda x: F.struct(
        F.coalesce(x["text"], F.lit("")).alias("text"), F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"), box(x["bounding_box"]).alias("bounding_box")))
    boxes = F.transform("checkboxes", lambda x: F.struct(
        box(x["position"]).alias("position"), F.coalesce(x["checked"], F.lit(False)).alias("checked"), F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence")))
    return F.struct(F.coalesce(lines, F.array()).alias("ocr_lines"), F.coalesce(boxes, F.array()).alias("checkboxes"))


def preprocessing_record() -> Column:
    """One page's preprocessing: paths, capture type and what it was decided by, and the time."""
    info = F.struct(F.col("capture_type").alias("type"), F.col("white_fraction").alias("white_percentage")).alias("capture_info")
    return F.struct(F.lit("success").alias("status"), "input_path", "processed_path", "capture_type", info, "processing_time")


def transform_record() -> Column:
    """One page's transform log, in order; the original's path only where there is one."""
    return F.struct("input_path", "output_path", "output_original_path", sorted_transforms(F.col("transforms")).alias("transforms"))


#: Records of one file: files are compressed, which repeats of names make worth it, and a compressed file is read by one task.
FILE_RECORDS = 200_000
#: What is kept of a page, by kind, and how its JSON is written: flags and preprocessing keep fields that are null.
RECORDS = {"flags": flag_record, "features": features_record, "preprocessing": preprocessing_record, "transforms": transform_record}
OPTIONS = {"flags": {"ignoreNullFields": "false"}, "preprocessing": {"ignoreNullFields": "false"}}


def page_records(rows: DataFrame, keys: list[str], kind: str = "flags") -> DataFrame:
    return rows.select(*keys, F.to_json(RECORDS[kind](), OPTIONS.get(kind)).alias("record"))


def write_page_records(rows: DataFrame, path: str, keys: list[str], kind: str = "flags") -> None:
    """One line per page and kind in gzip files, one or more for each partition; kinds lie side by side below the path.

    A record is an object within its line, not a text, so that it is written and parsed once.
    """
    writer = rows.select(*keys, RECORDS[kind]().alias("record")).write.mode("overwrite").options(
        maxRecordsPerFile=FILE_RECORDS, **{"zlib.compress.level": "BEST_SPEED"}, **OPTIONS.get(kind, {}))
    writer.json(f"{path}/kind={kind}", compression="gzip")


def read_page_records(spark: SparkSession, path: str, keys: str | None = None) -> DataFrame:
    """The records of all kinds below a path: the keys, ``kind`` and ``record`` as a VARIANT, whose fields need no schema.

    ``keys`` names the key columns and their types; without it, all files are read once more to find them.
    """
    if keys is None:
        found = spark.read.json(path).schema
        return spark.read.schema(StructType([StructField(f.name, VariantType() if f.name == "record" else f.dataType) for f in found])).json(path)
    return spark.read.schema(f"{keys}, record variant, kind string").json(path)


def write_labelled(files: DataFrame, path: str, label: str = "document_type") -> None:
    """Data set in one folder per label."""
    files.write.mode("overwrite").partitionBy(label).json(path)


def metadata_document(sidecars: DataFrame, kept: DataFrame) -> DataFrame:
    """Statistics row of the metadata document. ``total_pages`` counts every sidecar, the rates only the pages
    whose image exists. The pages themselves stay a table."""
    total = sidecars.agg(F.count(F.lit(1)).alias("total_pages"))
    # One row of figures as a scalar subquery: null when no page was kept.
    statistics = flag_statistics(kept).select(F.struct("*")).scalar()
    return total.select("total_pages", F.inline_outer(F.array(statistics)))


def write_metadata(sidecars: DataFrame, kept: DataFrame, path: str, generated_at: str) -> None:
    metadata_document(sidecars, kept).withColumn("generated_at", F.lit(generated_at)).write.mode("overwrite").json(f"{path}/statistics")
    kept.write.mode("overwrite").json(f"{path}/pages")


def expiring(rows: DataFrame, ttl_s: int, stamp_us: str = "ts_us") -> DataFrame:
    """Adds the instant at which a stored row stops being readable."""
    return rows.withColumn("expires_us", F.col(stamp_us) + F.lit(ttl_s * 1_000_000))


def readable(rows: DataFrame, as_of_us: int) -> DataFrame:
    return rows.where(F.col("expires_us") > F.lit(as_of_us))
