"""Transform logs and their replay over points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from pagemill.session import ship


def sorted_transforms(transforms: Column) -> Column:
    """Stable order: by ``order``, then by place in the log; a missing order counts 0."""
    keyed = F.transform(transforms, lambda t, i: F.struct(F.coalesce(t["order"], F.lit(0)).alias("o"), i.alias("i"), t.alias("t")))
    return F.sort_array(keyed)["t"]  # no element is null, so this is array_sort's order, without a comparison in lambdas


_CELLS = [f"m{i}{j}" for i in range(3) for j in range(3)]
_MATRIX, _PLACES = StructType(), StructType().add("moved", ArrayType(ArrayType(DoubleType())))
for _name in [*_CELLS, "w", "h"]:
    _MATRIX.add(_name, DoubleType())
for _name in ("final_width", "final_height"):
    _PLACES.add(_name, DoubleType())


def _numbers(column: pa.Array, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are null) of a column."""
    return column.cast(pa.from_numpy_dtype(kind)).fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _is(column: pa.Array, value: str) -> np.ndarray:
    return pc.equal(column, value).fill_null(False).to_numpy(zero_copy_only=False)


def _items(lists: pa.Array, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` items from each start on, (n, rows); those from its end on are null."""
    values, absent = _numbers(lists.values)
    at = starts + np.arange(n)[:, None]
    outside = at >= ends
    at = np.where(outside, len(values), at)
    return np.append(values, 0.0)[at], np.append(absent, True)[at]


class _Steps:
    """The transforms of a batch of logs, sorted within each log, as arrays of which each depth takes its own."""

    def __init__(self, logs: pa.Array):
        self.first = logs.offsets.to_numpy()[:-1].astype(np.int64)
        self.length = np.where(logs.is_null().to_numpy(zero_copy_only=False), 0, np.diff(logs.offsets.to_numpy()))
        steps = logs.values
        field = dict(zip([f.name for f in steps.type], steps.flatten()))
        own = dict(zip([f.name for f in field["params"].type], field["params"].flatten()))
        owner = np.repeat(np.arange(len(logs)), self.length)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        used = self.first[owner] + place
        order, _ = _numbers(field["order"], np.int64)  # a missing order counts 0
        self.at = used[np.lexsort((place, order[used], owner))]
        self.first = np.cumsum(self.length) - self.length

        kind, turn, matrix, size = field["transform_type"], own["rotation_type"], own["transform_matrix"], own["output_size"]
        angle, unknown = _numbers(own["angle"])
        rotation = _is(kind, "rotation")
        standard = _is(turn, "standard") | turn.is_null().to_numpy(zero_copy_only=False)
        complete = (matrix.is_valid().to_numpy(zero_copy_only=False)) & (size.is_valid().to_numpy(zero_copy_only=False))
        crop, deskew = _is(kind, "crop") & complete, _is(kind, "deskew") & complete
        self.given = crop | deskew
        self.free = rotation & ~standard & ~unknown
        self.quarter = np.where(rotation & standard & ~unknown & np.isin(angle, (90, 180, 270)), angle, 0)
        radians = np.radians(np.where(np.isfinite(angle), angle, np.nan))
        self.cos, self.sin = np.cos(radians), np.sin(radians)

        rows = np.where(deskew, 2, 3)
        ends = matrix.offsets.to_numpy()
        last = np.minimum(ends[:-1] + rows, ends[1:])
        inner = matrix.values.offsets.to_numpy()
        self.cells, self.void = _items(matrix.values, inner[ends[:-1]], inner[last], 9)
        torn = np.append(0, np.cumsum(matrix.values.is_null().to_numpy(zero_copy_only=False)))  # a missing row voids all
        self.void |= torn[last] > torn[ends[:-1]]
        self.cells[6:, deskew], self.void[6:, deskew] = np.array([[0.0], [0.0], [1.0]]), False
        ends = size.offsets.to_numpy()
        self.size, self.no_size = _items(size, ends[:-1], ends[1:], 2)

    def matrices(self, at: np.ndarray, size: np.ndarray, no_size: np.ndarray) -> tuple[np.ndarray, ...]:
        """The steps' matrices over (x, y, 1) (9, n) and the sizes after them (2, n), on pages of the sizes before, with what is null in them."""
        m, void, after, no_after = self.cells[:, at], self.void[:, at], self.size[:, at], self.no_size[:, at]
        w, h = size
        free, quarter = np.flatnonzero(self.free[at]), self.quarter[at]
        if len(free):
            a, b, cx, cy = self.cos[at[free]], self.sin[at[free]], np.floor(w[free] / 2), np.floor(h[free] / 2)
            zero = np.zeros(len(free))
            m[:, free] = [a, b, (1 - a) * cx - b * cy, -b, a, b * cx + (1 - a) * cy, zero, zero, zero + 1]
            void[:, free] = False
            void[2, free] = void[5, free] = no_size[0, free] | no_size[1, free]
            after[:, free], no_after[:, free] = size[:, free], no_size[:, free]
        # (angle, xx, xy, yx, yy, sides that shift x and y: 0 width, 1 height)
        for angle, xx, xy, yx, yy, by_x, by_y in ((90, 0, -1, 1, 0, 1, None), (180, -1, 0, 0, -1, 0, 1), (270, 0, 1, -1, 0, None, 0)):
            if not len(own := np.flatnonzero(quarter == angle)):
                continue
            m[:, own] = np.array([xx, xy, 0, yx, yy, 0, 0, 0, 1.0])[:, None]
            void[:, own] = False
            for cell, side in ((2, by_x), (5, by_y)):
                if side is not None:
                    m[cell, own], void[cell, own] = size[side, own] - 1, no_size[side, own]
            sides = [0, 1] if angle == 180 else [1, 0]
            after[:, own], no_after[:, own] = size[np.ix_(sides, own)], no_size[np.ix_(sides, own)]
        return m, void, after, no_after


def _composed(logs: pa.Array, width: pa.Array, height: pa.Array) -> tuple[np.ndarray, ...]:
    """Each log as one matrix (9, n) and the final size (2, n), with what is null in them; a missing log is null throughout."""
    n = len(logs)
    (w, no_w), (h, no_h) = _numbers(width), _numbers(height)
    m, void = np.repeat(np.eye(3).reshape(9, 1), n, axis=1), np.zeros((9, n), bool)
    size, no_size = np.stack([w, h]), np.stack([no_w, no_h])
    steps = _Steps(logs)
    for depth in range(steps.length.max(initial=0)):
        pages = np.flatnonzero(steps.length > depth)
        at = steps.at[steps.first[pages] + depth]
        known = steps.given[at] | steps.free[at] | (steps.quarter[at] != 0)
        pages, at = pages[known], at[known]
        own, own_void, size_after, no_after = steps.matrices(at, size[:, pages], no_size[:, pages])
        before, before_void = m[:, pages], void[:, pages]
        for i in range(3):
            for j in range(3):
                a, b = slice(3 * i, 3 * i + 3), slice(j, None, 3)
                x, y = own[a], before[b]
                m[3 * i + j, pages] = x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
                void[3 * i + j, pages] = (own_void[a] | before_void[b]).any(axis=0)
        size[:, pages], no_size[:, pages] = size_after, no_after
    missing = logs.is_null().to_numpy(zero_copy_only=False)
    return m, void | missing, size, no_size | missing


@F.arrow_udf(_MATRIX)
def _as_matrix(logs: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    with np.errstate(all="ignore"):
        m, void, size, no_size = _composed(logs, width, height)
    return pa.StructArray.from_arrays([pa.array(v, mask=x) for v, x in zip([*m, *size], [*void, *no_size])], [*_CELLS, "w", "h"])


@F.arrow_udf(_PLACES)
def _moved(points: pa.Array, logs: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    with np.errstate(all="ignore"):
        m, void, size, no_size = _composed(logs, width, height)
        offsets, absent = points.offsets.to_numpy(), points.is_null().to_numpy(zero_copy_only=False)
        page = np.repeat(np.arange(len(points)), np.diff(offsets))
        pairs = points.values.slice(offsets[0], len(page))
        ends = pairs.offsets.to_numpy()
        (x, y), (no_x, no_y) = _items(pairs, ends[:-1], ends[1:], 2)
        top, left, under = [m[i][page] * x + m[i + 1][page] * y + m[i + 2][page] for i in (0, 3, 6)]
        nowhere = [void[i : i + 3].any(axis=0)[page] | no_x | no_y for i in (0, 3, 6)]
        off = nowhere[2] | (under == 0)
        places = pa.array(np.stack([top / under, left / under], axis=1).ravel(), mask=np.stack([nowhere[0] | off, nowhere[1] | off], axis=1).ravel())
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(page) + 1, dtype=np.int32) * 2), places)
    moved = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), inner, mask=pa.array(absent))
    return pa.StructArray.from_arrays([moved, *[pa.array(v, mask=x) for v, x in zip(size, no_size)]], ["moved", "final_width", "final_height"])


def composed(pages: DataFrame, transforms: str = "transforms", width: str = "width", height: str = "height", name: str = "_m") -> DataFrame:
    """Adds the ordered log of each page as one matrix and the final size. Composition is associative, so points come after it.

    A step is computed for all pages of an Arrow batch at once, so the work of a page is arithmetic on columns. An unknown or
    incomplete transform changes nothing.
    """
    ship(pages.sparkSession)
    return pages.withColumn(name, _as_matrix(transforms, F.col(width).cast("double"), F.col(height).cast("double")))


def replay(pages: DataFrame, points: str = "corners", transforms: str = "transforms", width: str = "width", height: str = "height") -> DataFrame:
    """Each page's ordered transforms over its points; adds ``moved`` (points) and the final size. A point that ends at infinity has no place."""
    ship(pages.sparkSession)
    keep = [c for c in pages.columns if c not in ("moved", "final_width", "final_height")]
    done = pages.select(*keep, _moved(F.col(points).cast("array<array<double>>"), transforms, F.col(width).cast("double"), F.col(height).cast("double")).alias("_r"))
    return done.select(*keep, F.inline(F.array("_r")))
