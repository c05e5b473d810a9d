"""Row-wise helpers that need the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A plain projection may be copied by the optimizer: into every filter on the column and into every
    later expression that names it, which multiplies the work of parsed JSON and of stepwise rules. A
    one-row ``inline`` is generated code as well, but expressions and filters stay on their side of it.
    """
    keep = [c for c in rows.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select(*keep, F.inline_outer(F.array(row)))
