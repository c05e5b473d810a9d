"""Corner-list columns: array<array<double>> of [x, y] points.

The four-corner rules use fixed element access, which stays inside generated code; only the rules for
lists of any length use array functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.frames import once
from pagemill.functions.numbers import whole


def x_of(corners: Column, i: int | Column) -> Column:
    return F.get(F.get(corners, F.lit(i) if isinstance(i, int) else i), F.lit(0))


def y_of(corners: Column, i: int | Column) -> Column:
    return F.get(F.get(corners, F.lit(i) if isinstance(i, int) else i), F.lit(1))


def all_points(corners: Column) -> Column:
    """True when every entry has at least two coordinates."""
    four = reduce(lambda a, b: a & b, [F.coalesce(F.size(F.get(corners, F.lit(i))) >= 2, F.lit(False)) for i in range(4)])
    many = F.forall(corners, lambda c: F.coalesce(F.size(c) >= 2, F.lit(False)))
    return F.when(F.size(corners) == 4, four).otherwise(many)


def bounding_box(corners: Column) -> Column:
    xs = F.transform(corners, lambda c: F.get(c, F.lit(0)))
    ys = F.transform(corners, lambda c: F.get(c, F.lit(1)))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def four_points(rows: DataFrame, corners: str = "corners", size: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds the coordinates of four-corner lists as plain columns ``_x0`` .. ``_y3`` (null for other lists).

    With a page size, relative coordinates (none above 1) become pixels.
    """
    points = F.col(corners)
    measured = rows.withColumns({
        "_four": F.coalesce((F.size(points) == 4) & all_points(points), F.lit(False)), "_top": F.array_max(F.flatten(points))})

    def value(axis, i: int, side: int) -> Column:
        raw = axis(points, i)
        return raw if size is None else F.when(F.col("_top") <= 1.0, raw * size[side]).otherwise(raw)

    axes = (("_x", x_of, 0), ("_y", y_of, 1))
    coordinates = {f"{n}{i}": F.when(F.col("_four"), value(axis, i, side)) for i in range(4) for n, axis, side in axes}
    return once(measured, coordinates).drop("_four", "_top")


def corner_indices(rows: DataFrame) -> DataFrame:
    """Adds the positions of top-left and bottom-right (smallest and largest x + y, first one on ties) and of
    the other two corners in ascending order; expects ``four_points``."""
    s = [F.col(f"_x{i}") + F.col(f"_y{i}") for i in range(4)]

    def first(target: Column) -> Column:
        return F.when(s[0] == target, 0).when(s[1] == target, 1).when(s[2] == target, 2).when(s[3] == target, 3)

    ends = once(rows, {"_tl": first(F.least(*s)), "_br": first(F.greatest(*s))})
    rest = F.array_except(F.array(*[F.lit(i) for i in range(4)]), F.array("_tl", "_br"))
    known = F.col("_tl").isNotNull()
    return once(ends, {"_a": F.when(known, F.get(rest, F.lit(0))), "_b": F.when(known, F.get(rest, F.lit(1)))})


def ordered() -> Column:
    """The points as top-left, top-right, bottom-right, bottom-left; expects ``corner_indices``."""
    xs = F.array(*[f"_x{i}" for i in range(4)])
    points = F.array(*[F.array(f"_x{i}", f"_y{i}") for i in range(4)])
    first_is_right = F.get(xs, F.col("_a")) > F.get(xs, F.col("_b"))
    right = F.when(first_is_right, F.col("_a")).otherwise(F.col("_b"))
    left = F.when(first_is_right, F.col("_b")).otherwise(F.col("_a"))
    quad = F.array(*[F.get(points, i) for i in (F.col("_tl"), right, F.col("_br"), left)])
    return F.when(F.col("_tl").isNotNull(), quad)


POINT_COLUMNS = [f"_{a}{i}" for i in range(4) for a in "xy"] + ["_tl", "_br", "_a", "_b"]


def quad_area() -> Column:
    """Area of the four points over truncated coordinates; expects ``four_points``."""
    x = [whole(F.col(f"_x{i}")) for i in range(4)]
    y = [whole(F.col(f"_y{i}")) for i in range(4)]
    doubled = reduce(lambda t, i: t + x[i] * y[(i + 1) % 4] - x[(i + 1) % 4] * y[i], range(4), F.lit(0).cast("bigint"))
    return F.abs(doubled).cast("double") / 2


def scaled(corners: Column, width: Column, height: Column) -> Column:
    """Relative coordinates (none above 1) become pixels; pixels stay."""
    top = F.array_max(F.flatten(corners))
    four = F.array(*[F.array(x_of(corners, i) * width, y_of(corners, i) * height) for i in range(4)])
    many = F.transform(corners, lambda c: F.array(F.get(c, F.lit(0)) * width, F.get(c, F.lit(1)) * height))
    return F.when(top <= 1.0, F.when(F.size(corners) == 4, four).otherwise(many)).otherwise(corners)


def area(corners: Column) -> Column:
    """Area of a polygon with any number of points over truncated coordinates."""
    count = F.size(corners)

    def cross(point: Column, i: Column) -> Column:
        following = F.get(corners, (i + 1) % count)
        return (
            whole(F.get(point, F.lit(0))) * whole(F.get(following, F.lit(1)))
            - whole(F.get(following, F.lit(0))) * whole(F.get(point, F.lit(1)))
        )

    doubled = F.aggregate(F.transform(corners, cross), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return F.abs(doubled).cast("double") / 2


EDGES = ("top", "bottom", "left", "right")


def edge_margins(corners: Column, width: Column, height: Column) -> Column:
    """Distance of the box of four points from each page edge, in percent."""
    return margins_of([x_of(corners, i) for i in range(4)], [y_of(corners, i) for i in range(4)], width, height)


def margins_of(xs: list[Column], ys: list[Column], width: Column, height: Column) -> Column:
    return F.struct(
        (F.try_divide(F.least(*ys), height) * 100).alias("top"),
        (F.try_divide(height - F.greatest(*ys), height) * 100).alias("bottom"),
        (F.try_divide(F.least(*xs), width) * 100).alias("left"),
        (F.try_divide(width - F.greatest(*xs), width) * 100).alias("right"),
    )


def centred_margins(width: Column, height: Column, final_width: Column, final_height: Column) -> Column:
    """Margin estimate when the corners are unknown: the crop is taken as centred."""
    margin = (1 - F.least(F.try_divide(final_width, width), F.try_divide(final_height, height))) * 50
    return F.struct(*[margin.alias(e) for e in EDGES])


def smallest(margins: Column) -> Column:
    return reduce(F.least, [margins[e] for e in EDGES[1:]], margins[EDGES[0]])


def edge_length(corners: Column, i: int, j: int) -> Column:
    dx, dy = x_of(corners, i) - x_of(corners, j), y_of(corners, i) - y_of(corners, j)
    return F.sqrt(dx * dx + dy * dy)


def output_size(corners: Column) -> Column:
    """Width and height of the straightened quad (ordered corners in)."""
    return F.struct(
        whole(F.greatest(edge_length(corners, 1, 0), edge_length(corners, 2, 3))).alias("width"),
        whole(F.greatest(edge_length(corners, 3, 0), edge_length(corners, 2, 1))).alias("height"),
    )
