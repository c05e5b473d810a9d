"""File listings, upload checks, labelled directories and OCR-style JSON files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.names import extension, has_extension, parent_name
from pagemill.params import LISTED_EXTENSIONS, UPLOAD_EXTENSIONS
from pagemill.sources.listing import listing


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = LISTED_EXTENSIONS) -> DataFrame:
    """Files below a folder with one of the extensions (any case), sorted by path, empty ones too. Contents are not read."""
    return wanted_files(listing(spark, root), extensions)


def wanted_files(files: DataFrame, extensions: tuple[str, ...] = LISTED_EXTENSIONS) -> DataFrame:
    return files.where(has_extension(F.col("path"), extensions)).orderBy("path")


def check_uploads(files: DataFrame, extensions: tuple[str, ...] = UPLOAD_EXTENSIONS) -> DataFrame:
    """Adds the lower-case extension or the reason of the first broken rule."""
    ext = F.lower(extension(F.col("path")))
    reason = (
        F.when(F.col("path").isNull() | (F.col("path") == ""), "name_missing")
        .when(ext == "", "no_extension")
        .when(~ext.isin(*extensions), "unsupported_extension")
        .when(F.coalesce("size", F.lit(0)) == 0, "empty_file")
    )
    return files.withColumn("reject_reason", reason).withColumn("extension", F.when(F.col("reject_reason").isNull(), ext))


def labelled_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(path, class_name) of files in class folders: the parent folder is the class."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return with_class(listing.select(F.col("_metadata.file_path").alias("path")))


def with_class(files: DataFrame) -> DataFrame:
    return files.withColumn("class_name", parent_name(F.col("path")))
