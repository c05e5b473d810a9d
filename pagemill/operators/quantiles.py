"""Exact medians and positions in a total order that never hold a whole group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import shared_dir

#: Distinct values of a key that a window may rank, and the parts that a wider range is cut into.
RANKED, PARTS = 4096, 64


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per key (mean of the middle two for an even count), also for keys of any size.

    Rows are counted per (key, value), pre-aggregated before the shuffle. A key of at most ``RANKED`` values is ranked;
    the values of others are narrowed first (see ``narrowed_medians``). A key without values has no row.
    """
    few, many = split(counted(rows, keys, value), keys)
    found = with_medians(few, keys).where("_place = 1").select(*keys, "median")
    return found if many is None else found.unionByName(narrowed_medians(many, keys))


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (``_n``) per key and present value (``_v``), checkpointed."""
    shared_dir(rows.sparkSession)
    present = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    return present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).checkpoint()


def split(counts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The counts of keys that a window may rank, and those of wider keys (None without any).

    Only wide keys are joined, and at most one in ``RANKED`` counts has one, so the usual case joins and sorts nothing here.
    """
    wide = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct")).where(F.col("_distinct") > RANKED).drop("_distinct").checkpoint()
    if wide.isEmpty():
        return counts, None
    if not keys:
        return counts.where("false"), counts
    return beside(counts, wide, keys, "left_anti"), beside(counts, wide, keys, "left_semi")


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which a null equals a null, as in a grouping."""
    named = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_key_{k}" for k in keys])


def with_medians(few: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys of at most ``RANKED`` values beside ``median``, rows of the key (``_total``) and place among its values
    (``_place``, from 1): one sort, and no aggregation or join after it."""
    own = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_v")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = few.withColumns({"_upto": F.sum("_n").over(own), "_total": F.sum("_n").over(whole), "_place": F.row_number().over(own)})

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("_upto") >= F.expr(rank), F.col("_v"))).over(whole)

    return placed.withColumn("median", (at("(_total + 1) div 2") + at("(_total + 2) div 2")) / 2).drop("_upto")


def narrowed_medians(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact median per key from counts, for keys with any number of values.

    While the values that may be a key's middle are more than ``RANKED``, they are cut into ``PARTS`` at approximate
    quantiles and counted per part, and only the parts that hold the middle ranks stay; each pass leaves about a thirtieth,
    whatever the distribution, and sorts nothing. The last few values are ranked.
    """
    whole = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_distinct"))
    bounds = whole.where("_total IS NOT NULL").withColumn("_below", F.lit(0).cast("bigint")).checkpoint()
    while not (wide := bounds.where(F.col("_distinct") > RANKED)).isEmpty():
        narrowed = _narrowed(_inside(counts, wide, keys), keys)
        bounds = bounds.where(F.col("_distinct") <= RANKED).unionByName(narrowed.select(*bounds.columns)).checkpoint()
    own = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_v")  # RANKED values at most
    placed = _inside(counts, bounds, keys).withColumn("_upto", F.col("_below") + F.sum("_n").over(own))

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("_upto") >= F.expr(rank), F.col("_v")))

    middle = placed.groupBy(*keys).agg(at("(_total + 1) div 2").alias("_a"), at("(_total + 2) div 2").alias("_z"))
    return middle.where("_a IS NOT NULL").select(*keys, ((F.col("_a") + F.col("_z")) / 2).alias("median"))


def _inside(counts: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """The counted values within their key's bounds; a single group's bounds are one value, so nothing is joined."""
    own = [c for c in bounds.columns if c not in keys]
    if keys:
        joined = beside(counts, bounds, keys)
    else:
        box = bounds.select(F.struct(*own)).scalar()
        joined = counts.withColumns({c: box[c] for c in own})
    return joined.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _narrowed(inside: DataFrame, keys: list[str]) -> DataFrame:
    """New bounds: the parts that hold the middle ranks."""
    cuts = inside.groupBy(*keys).agg(F.percentile_approx("_v", [i / PARTS for i in range(1, PARTS)], 100 * PARTS).alias("_cuts"))
    if keys:
        cut = beside(inside, cuts, keys)
    else:
        cut = inside.withColumn("_cuts", cuts.select("_cuts").scalar())
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    parts = cut.withColumn("_part", part).groupBy(*keys, "_part").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_distinct"),
        F.max("_total").alias("_total"), F.max("_below").alias("_below"))
    own = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")  # PARTS rows
    placed = parts.withColumn("_upto", F.col("_below") + F.sum("_rows").over(own)).withColumn("_below", F.col("_upto") - F.col("_rows"))
    held = placed.where("_upto >= (_total + 1) div 2 AND _below < (_total + 2) div 2")
    return held.groupBy(*keys).agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_total").alias("_total"), F.sum("_distinct").alias("_distinct"), F.min("_below").alias("_below"))


def positions(rows: DataFrame, order: list[Column], keys: list[str] | None = None, name: str = "position") -> DataFrame:
    """0-based position of every row in a total order, optionally restarting per key.

    A window over the whole table would sort it in one task. Here the rows are range-sorted once and
    checkpointed, which fixes their partitions; a row's position is its place in its partition plus the
    sizes of the partitions before it (one row per partition). Positions restart per key by subtracting
    the key's smallest position.
    """
    keys = keys or []
    shared_dir(rows.sparkSession)
    placed = rows.orderBy(*[F.col(k) for k in keys], *order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumns({"_part": part, "_local": local}).drop("_id")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    running = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(running), F.lit(0)).alias("_offset"))
    numbered = placed.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_local"))
    if keys:
        starts = numbered.groupBy(*keys).agg(F.min(name).alias("_start"))
        numbered = numbered.join(starts, keys).withColumn(name, F.col(name) - F.col("_start")).drop("_start")
    return numbered.drop("_part", "_local", "_offset")
