"""Stages by name, in a fixed order, as one lazy chain over pages.

A failing page carries its error in a column and gets no later decisions; it never fails the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.numbers import softmax
from pagemill.operators.capture import capture_types
from pagemill.operators.geometry import crop_decisions, deskew_decisions, normalise_orientation, rotation_decisions
from pagemill.operators.lines import PAGE
from pagemill.operators.scoring import score
from pagemill.operators.vectors import document_vectors
from pagemill.params import Params

# Stage names in running order; 'colometry' runs only on request.
ORDER = ("preprocessing", "colometry", "geometry", "features", "classification")
DEFAULT = ("preprocessing", "geometry", "features", "classification")
DECISIONS = ["crop_status", "deskew_status", "rotation_status"]


@dataclass(frozen=True)
class Inputs:
    """What the stages read besides the page table."""

    lines: DataFrame | None = None
    classes: DataFrame | None = None
    semantic_dim: int = 0
    # Scores of a page vector as an array column; the default takes a softmax of the vector itself.
    scorer: Callable[[Column], Column] = softmax


def _alive(column: str) -> Column:
    return F.when(F.col("error").isNull(), F.col(column))


def preprocessing(pages: DataFrame, inputs: Inputs, p: Params) -> DataFrame:
    """Capture type; a page without pixel measures is a PHOTO with an error."""
    failed = pages.withColumn("error", F.coalesce("error", F.when(F.col("white_fraction").isNull(), "image unreadable")))
    return capture_types(failed, p, error="error")


def colometry(pages: DataFrame, inputs: Inputs, p: Params) -> DataFrame:
    return pages


def geometry(pages: DataFrame, inputs: Inputs, p: Params) -> DataFrame:
    """Crop, deskew and rotation decisions of readable pages."""
    if "capture_type" not in pages.columns:
        pages = pages.withColumn("capture_type", F.lit("PHOTO"))
    decided = rotation_decisions(normalise_orientation(deskew_decisions(crop_decisions(pages, p), p)), p)
    return decided.withColumns({c: _alive(c) for c in DECISIONS})


def features(pages: DataFrame, inputs: Inputs, p: Params) -> DataFrame:
    return document_vectors(inputs.lines, pages, inputs.semantic_dim, p, PAGE)


def classification(pages: DataFrame, inputs: Inputs, p: Params) -> DataFrame:
    scored = score(pages.withColumn("probabilities", inputs.scorer(F.col("vector"))), inputs.classes, p)
    return scored.withColumns({c: _alive(c) for c in ("class_index", "confidence", "document_type")}).drop("probabilities")


STAGES = {"preprocessing": preprocessing, "colometry": colometry, "geometry": geometry, "features": features, "classification": classification}


def chosen(names: tuple[str, ...] = DEFAULT) -> list[str]:
    unknown = set(names) - set(ORDER)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    return [n for n in ORDER if n in names]


def run(pages: DataFrame, inputs: Inputs, names: tuple[str, ...] = DEFAULT, p: Params = Params()) -> DataFrame:
    """Run the chosen stages over a page table (doc_id, page_index and the measures the stages read)."""
    pages = pages.withColumn("error", F.lit(None).cast("string")) if "error" not in pages.columns else pages
    for name in chosen(names):
        pages = STAGES[name](pages, inputs, p)
    return pages.withColumn("stages", F.lit(">".join(chosen(names))))
