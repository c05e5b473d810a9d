"""All registered queries and their SQL."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import ship

MODULES = ["lines", "geometry", "quality", "documents", "failures", "scoring", "training", "files", "monitoring", "streams"]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"pagemill.plans.{name}"), attribute)
        repeated = found.keys() & part.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        found.update(part)
    return found


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package given to the session's Python workers first."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in _collect("QUERIES").items()}


def oracles() -> dict[str, str]:
    return _collect("ORACLE")
