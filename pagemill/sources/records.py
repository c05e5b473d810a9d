"""Text-line records, quality sidecars and transform logs: JSON text to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.frames import once
from pagemill.functions.names import has_extension

_LINE = "struct<text: string, confidence: double, bounding_box: string, line_no: bigint>"
LINE_SCHEMA = f"ocr_lines array<{_LINE}>, features struct<ocr_lines: array<{_LINE}>>, lines array<{_LINE}>"
LIST_SCHEMA = f"array<{_LINE}>"

PARAMS = "struct<angle: double, rotation_type: string, status: string, transform_matrix: array<array<double>>, output_size: array<bigint>>"
LOG_SCHEMA = (
    "input_path string, output_path string, output_transformed_path string,"
    f" transforms array<struct<transform_type: string, params: {PARAMS}, `order`: int>>"
)


def parse_line_records(records: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """One row per text line from records in any of four shapes: ``ocr_lines``, ``features.ocr_lines``,
    ``lines`` or a bare list. Boxes come as ``box`` (four numbers) or ``corners`` (points)."""
    is_list = F.trim(record).startswith("[")
    typed = once(records.select(*keys, record), {
        "_o": F.when(~is_list, F.from_json(record, LINE_SCHEMA)), "_l": F.when(is_list, F.from_json(record, LIST_SCHEMA))})
    lines = F.coalesce("_l", "_o.ocr_lines", "_o.features.ocr_lines", "_o.lines")
    rows = typed.select(*keys, F.posexplode(lines).alias("place", "_x"))
    box = F.col("_x.bounding_box")
    return rows.select(
        *keys, "place", F.col("_x.line_no").alias("line_no"), F.col("_x.text").alias("text"), F.col("_x.confidence").alias("confidence"),
        F.when(~box.startswith("[["), F.from_json(box, "array<double>")).alias("box"),
        F.when(box.startswith("[["), F.from_json(box, "array<array<double>>")).alias("corners"),
    )


def read_records(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Whole JSON files as (path, record)."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("record"))


def parse_transform_logs(logs: DataFrame, keys: list[str], log: str = "log") -> DataFrame:
    """Transform logs with the old path key as fallback; a missing order counts 0."""
    typed = once(logs, {"_t": F.from_json(log, LOG_SCHEMA)})
    orders = F.transform("_t.transforms", lambda t: t.withField("order", F.coalesce(t["order"], F.lit(0))))
    return typed.select(
        *[c for c in logs.columns if c != log], F.col("_t.input_path").alias("input_path"),
        F.coalesce("_t.output_path", "_t.output_transformed_path").alias("output_path"), orders.alias("transforms"))


FLAG_SCHEMA = (
    "low_confidence_orientation boolean, overcrop_risk boolean, no_quad_detected boolean, dewarp_applied boolean,"
    " low_contrast_after_enhance boolean, too_small_final boolean, rotated boolean, orientation_confidence double,"
    " orientation_angle int, deskew_angle double, deskew_confidence double, crop_margins map<string,double>,"
    " final_resolution array<int>, processing_time double, capture_type string, capture_white_percentage double"
)


def read_quality_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.qa.json`` below a folder with its flags."""
    records = read_records(spark, root, "*.qa.json")
    return records.select("path", F.from_json("record", FLAG_SCHEMA).alias("_q")).select("path", F.inline_outer(F.array("_q")))


def read_images_listing(spark: SparkSession, root: str) -> DataFrame:
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listing = listing.select(F.col("_metadata.file_path").alias("path"))
    return listing.where(has_extension(F.col("path"), (".png", ".jpg")))


def read_transform_logs(spark: SparkSession, root: str) -> DataFrame:
    return parse_transform_logs(read_records(spark, root, "*.transform.json"), ["path"], "record")
