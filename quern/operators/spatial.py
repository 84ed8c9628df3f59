"""Joins in space: points within reach, boxes that overlap, cells that discs cover.

None of these is an equality, and a plain join on them compares every pair. Here both sides are dealt
to the cells of a grid and joined on the cell; the exact test follows. A cell as large as the reach
leaves at most the neighbouring cells to look at. Skewed cells are split by adaptive execution, since the
join is an ordinary equi-join of two shuffled sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _around(df: DataFrame, axes: list[str], size: float, reach: float, prefix: str) -> DataFrame:
    """One row for each cell that the box of ``reach`` around a point touches."""
    for a in axes:
        cells = F.sequence(_cell(F.col(a) - reach, size), _cell(F.col(a) + reach, size))
        df = df.withColumn(prefix + a, F.explode(cells))
    return df


def within_reach(left: DataFrame, right: DataFrame, axes: list[str], reach: float, key: str, strict: bool = True, how: str = "semi", keep: Column | None = None) -> DataFrame:
    """Rows of ``left`` that have (``semi``) or lack (``anti``) a row of ``right`` nearer than ``reach``.

    Both sides hold the columns ``axes``; ``key`` identifies the rows of ``left``. Null coordinates are near
    nothing. A negative reach means no limit: any row of ``right`` will do. ``keep`` filters ``right``.
    """
    right = right if keep is None else right.where(keep)
    join = "left_semi" if how == "semi" else "left_anti"
    if reach < 0:
        any_right = right.select(F.lit(True).alias("__any")).limit(1)
        return left.withColumn("__any", F.lit(True)).join(any_right, "__any", join).drop("__any")
    size = reach or 1.0
    points = left.select(key, *axes)
    for a in axes:
        points = points.withColumn(f"__c{a}", _cell(F.col(a), size))
    others = _around(right.select(*(F.col(a).alias(f"__r{a}") for a in axes)).distinct(), [f"__r{a}" for a in axes], size, reach, "__d")
    same = reduce(lambda x, y: x & y, [F.col(f"__c{a}") == F.col(f"__d__r{a}") for a in axes])
    d2 = reduce(lambda x, y: x + y, [(F.col(a) - F.col(f"__r{a}")) * (F.col(a) - F.col(f"__r{a}")) for a in axes])
    near = d2 < reach * reach if strict else d2 <= reach * reach
    found = points.join(others, same & near, "left_semi").select(key).distinct()
    return left.join(found, key, join)


def overlap(a: str, b: str, axes: str = "xyz") -> Column:
    """Whether two boxes (columns prefix + min_/max_ + axis) share more than an edge."""
    return reduce(lambda x, y: x & y, [(F.col(f"{a}min_{k}") < F.col(f"{b}max_{k}")) & (F.col(f"{a}max_{k}") > F.col(f"{b}min_{k}")) for k in axes])


def _box_cells(df: DataFrame, axes: str, size: float) -> DataFrame:
    for k in axes:
        df = df.withColumn(f"__{k}", F.explode(F.sequence(_cell(F.col(f"min_{k}"), size), _cell(F.col(f"max_{k}"), size))))
    return df


def boxes_overlapping(left: DataFrame, right: DataFrame, key: str, size: float, axes: str = "xyz", how: str = "semi", not_self: str | None = None) -> DataFrame:
    """Boxes of ``left`` that overlap some box of ``right``, or none (``anti``).

    ``size`` is the edge of a grid cell; boxes much larger take part in many cells. With ``not_self``, a box
    does not count for a box of that same column's value.
    """
    names = [f"{m}_{k}" for k in axes for m in ("min", "max")]
    a = _box_cells(left.select(*dict.fromkeys([key, *names, *([not_self] if not_self else [])])), axes, size)
    b = _box_cells(right.select(*names, *([not_self] if not_self else [])), axes, size)
    b = b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns))
    same = reduce(lambda x, y: x & y, [F.col(f"__{k}") == F.col(f"r___{k}") for k in axes])
    test = same & overlap("", "r_", axes)
    if not_self:
        test = test & (F.col(not_self) != F.col(f"r_{not_self}"))
    found = a.join(b, test, "left_semi").select(key).distinct()
    return left.join(found, key, "left_semi" if how == "semi" else "left_anti")


def contained(bounds: dict[str, tuple[float, float]]) -> Column:
    """Whether a box lies inside bounds, edges included."""
    return reduce(lambda x, y: x & y, [(F.col(f"min_{k}") >= lo) & (F.col(f"max_{k}") <= hi) for k, (lo, hi) in bounds.items()])


def free_boxes(boxes: DataFrame, taken: DataFrame, bounds: dict[str, tuple[float, float]], key: str, size: float) -> DataFrame:
    """Boxes inside the bounds that overlap none of the taken ones."""
    axes = "".join(bounds)
    return boxes_overlapping(boxes.where(contained(bounds)), taken, key, size, axes, how="anti")


def points_in_boxes(points: DataFrame, boxes: DataFrame, key: str, size: float, axes: str = "xyz") -> DataFrame:
    """Points inside some box: lower edge included, upper edge not."""
    p = points.select(key, *axes)
    for k in axes:
        p = p.withColumn(f"__p{k}", _cell(F.col(k), size))
    b = _box_cells(boxes.select(*(f"{m}_{k}" for k in axes for m in ("min", "max"))), axes, size)
    test = reduce(lambda x, y: x & y, [(F.col(f"__p{k}") == F.col(f"__{k}")) & (F.col(k) >= F.col(f"min_{k}")) & (F.col(k) < F.col(f"max_{k}")) for k in axes])
    return points.join(p.join(b, test, "left_semi").select(key).distinct(), key, "left_semi")


def disc_cover(centres: DataFrame, radius: int, x: str = "x", z: str = "z") -> DataFrame:
    """The distinct cells within ``radius`` cells of any centre, edge included."""
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    each = centres.select(x, z).distinct().withColumn("o", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets))))
    return each.select((F.col(x) + F.col("o.i")).alias(x), (F.col(z) + F.col("o.j")).alias(z)).distinct()


def tile_bits(cells: DataFrame, edge_bits: int = 3, x: str = "x", z: str = "z") -> DataFrame:
    """Cells as one bit each of a long for every tile of 2**edge_bits by 2**edge_bits cells."""
    mask = (1 << edge_bits) - 1
    bit = F.col(z).bitwiseAND(F.lit(mask)) * (mask + 1) + F.col(x).bitwiseAND(F.lit(mask))
    one = F.expr("bigint(1)")
    return cells.groupBy(F.shiftright(x, edge_bits).alias("tile_x"), F.shiftright(z, edge_bits).alias("tile_z")).agg(F.bit_or(F.call_function("shiftleft", one, bit.cast("int"))).alias("bits"))


def inside_border(x: Column, z: Column, centre: tuple[float, float], half: float) -> Column:
    """Whether a point lies inside a square border: lower edges included, upper ones not."""
    return (x >= centre[0] - half) & (x < centre[0] + half) & (z >= centre[1] - half) & (z < centre[1] + half)


def pairs_within(left: DataFrame, right: DataFrame, axes: list[str], reach: float, strict: bool = True) -> DataFrame:
    """All pairs of a row of ``left`` and one of ``right`` nearer than ``reach``, with the squared distance ``d2``. Both have the
    columns ``axes``, which come out as those of ``left``; their other columns must have different names.

    Both sides are dealt to cells as large as the reach and joined on the cell, so work grows with the pairs that are near.
    """
    a = left
    for x in axes:
        a = a.withColumn(f"__c{x}", _cell(F.col(x), reach))
    b = _around(right.withColumnsRenamed({x: f"__r{x}" for x in axes}), [f"__r{x}" for x in axes], reach, reach, "__d")
    same = reduce(lambda x, y: x & y, [F.col(f"__c{x}") == F.col(f"__d__r{x}") for x in axes])
    d2 = reduce(lambda x, y: x + y, [(F.col(x) - F.col(f"__r{x}")) * (F.col(x) - F.col(f"__r{x}")) for x in axes])
    near = d2 < reach * reach if strict else d2 <= reach * reach
    joined = a.join(b, same & near).withColumn("d2", d2)
    return joined.drop(*(f"{p}{x}" for x in axes for p in ("__c", "__r", "__d__r")))


def some_within(centres: DataFrame, others: DataFrame, axes: list[str], reach: float, key: str, tie: str, n: int) -> DataFrame:
    """Up to ``n`` of the others within reach of each centre, the nearest first, then by ``tie``; ``place`` counts from 1."""
    from .ranking import top_k_per_key

    return top_k_per_key(pairs_within(centres, others, axes, reach, strict=False), [key], [F.col("d2")], [tie], n)


def by_reach_class(centres: DataFrame, others: DataFrame, axes: list[str], reaches: dict[str, float], key: str) -> DataFrame:
    """(key, class, n): how many others lie within each class of reach of a centre; classes without any have no row.

    The pairs of the largest reach are made once, and every class counts those that are near enough.
    """
    pairs = pairs_within(centres.select(key, *axes), others.select(*axes), axes, max(reaches.values()))
    inside = F.array_compact(F.array(*(F.when(F.col("d2") < r * r, F.lit(name)) for name, r in reaches.items())))
    return pairs.select(key, F.explode(inside).alias("class")).groupBy(key, "class").agg(F.count("*").alias("n"))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and an interval that holds it, ends included. Intervals are dealt to bins of ``width`` and joined on the
    bin: an interval much longer than a bin takes part in many."""
    bins = intervals.withColumn("__bin", F.explode(F.sequence(_cell(F.col(low), width), _cell(F.col(high), width))))
    placed = points.withColumn("__at", _cell(F.col(at), width))
    return placed.join(bins, (F.col("__at") == F.col("__bin")) & F.col(at).between(F.col(low), F.col(high))).drop("__at", "__bin")


def inside_or_first(rows: DataFrame, group: str, order: str, inside: Column) -> DataFrame:
    """The rows of each group that lie inside; of a group without any, its first row by ``order`` and then by all columns."""
    told = rows.withColumn("__inside", F.coalesce(inside, F.lit(False)))
    first = F.min(F.struct(order, *(c for c in rows.columns if c not in (order, group)))).alias("f")
    alone = told.groupBy(group).agg(F.bool_or("__inside").alias("any"), first).where(~F.col("any"))
    return told.where("__inside").drop("__inside").unionByName(alone.select(group, *(F.col(f"f.{c}").alias(c) for c in rows.columns if c != group)))


def nearest_cell(centres: DataFrame, levels: DataFrame, radius: int, key: str, axes: str = "xyz") -> DataFrame:
    """For each centre (key, axes, level) the cell of the cube around it with the least level, if that is less than the centre's
    own, else the centre: the first by axes in order x, z, y. ``levels`` has axes and level; cells that it lacks do not count."""
    order = [a for a in "xzy" if a in axes]
    around = centres
    for a in axes:
        around = around.withColumn(f"n{a}", F.explode(F.sequence(F.col(a) - radius, F.col(a) + radius)))
    there = levels.select(*(F.col(a).alias(f"n{a}") for a in axes), F.col("level").alias("l"))
    best = around.join(there, [f"n{a}" for a in axes]).where("l < level").groupBy(key).agg(F.min(F.struct("l", *(f"n{a}" for a in order))).alias("b"))
    return centres.join(best, key, "left").select(key, *(F.coalesce(f"b.n{a}", a).alias(a) for a in axes), F.coalesce("b.l", "level").alias("level"))
