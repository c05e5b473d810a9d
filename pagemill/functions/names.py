"""File-name rules: stem, extension, derived output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns of derived files.
ORIGINAL, TRANSFORMED = "_original", "_transformed"
_NAME = r"([^/]*)$"
_EXTENSION = r"[^/](\.[^/.]+)$"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, _NAME, 1)


def extension(path: Column) -> Column:
    """The last suffix with its dot, case kept; empty when there is none (a leading dot is no suffix)."""
    return F.regexp_extract(path, _EXTENSION, 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def output_path(path: Column, folder: Column, suffix: str = "") -> Column:
    tail = F.lit(f"_{suffix}" if suffix else "")
    return F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), stem(path), tail, extension(path))


def original_twin(path: Column) -> Column:
    """Name of the untouched image that belongs to a transformed one."""
    name = stem(path)
    marked = F.contains(name, F.lit(TRANSFORMED))
    twin = F.when(marked, F.replace(name, F.lit(TRANSFORMED), F.lit(ORIGINAL))).otherwise(F.concat(name, F.lit(ORIGINAL)))
    return F.concat(twin, extension(path))


def page_name(path: Column, page_number: Column) -> Column:
    return F.concat(stem(path), F.lit("_page"), page_number.cast("string"))


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    """Case-insensitive suffix test."""
    lowered = F.lower(path)
    test = F.lit(False)
    for ext in extensions:
        test = test | F.endswith(lowered, F.lit(ext.lower()))
    return test


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
