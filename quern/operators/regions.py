"""Regions of sections: ownership of rectangles, user-defined mergeable states, per-region functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pack_xz


def owned_rectangles(rects: DataFrame, sections: DataFrame, key: str, shift: int) -> DataFrame:
    """(key, owned, region): whether all sections that a rectangle (x0, z0, x1, z1 in cells) touches belong to one region.

    ``sections`` has section_key and region. A section without a region is owned by nobody.
    """
    xs = F.sequence(F.shiftright("x0", shift), F.shiftright("x1", shift))
    zs = F.sequence(F.shiftright("z0", shift), F.shiftright("z1", shift))
    each = rects.select(key, F.explode(xs).alias("sx"), zs.alias("zs")).select(key, "sx", F.explode("zs").alias("sz"))
    found = each.withColumn("section_key", pack_xz(F.col("sx"), F.col("sz"))).join(sections.select("section_key", "region"), "section_key", "left")
    out = found.groupBy(key).agg(F.bool_and(F.col("region").isNotNull()).alias("known"), F.min("region").alias("region"), F.max("region").alias("top"))
    owned = F.col("known") & (F.col("region") == F.col("top"))
    return out.select(key, F.coalesce(owned, F.lit(False)).alias("owned"), F.when(owned, F.col("region")).alias("region"))


def reach(x: Column, z: Column, vx: Column, vz: Column, buffer: int) -> list[Column]:
    """(x0, z0, x1, z1): the cells that something moving from a place by a velocity can touch, with a buffer around."""
    ends = [(a, a + v) for a, v in ((x, vx), (z, vz))]
    low = [(F.floor(F.least(*e)) - buffer).cast("int") for e in ends]
    high = [(F.floor(F.greatest(*e)) + buffer).cast("int") for e in ends]
    return [low[0].alias("x0"), low[1].alias("z0"), high[0].alias("x1"), high[1].alias("z1")]


def merged_by(df: DataFrame, key: str, create: Callable[[], dict], add: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """A state of the user's own for each key: ``create`` makes an empty one, ``add`` takes in a row or a partial state.

    Partial states are made in each task first and merged by key then, so a frequent key shuffles one row a task.
    """

    def fold(frames) -> dict:
        states: dict = {}
        for f in frames:
            for row in f.to_dict("records"):
                k = row[key]
                states[k] = add(states.get(k) or create(), row)
        return states

    def partial(frames):
        rows = [{key: k} | s for k, s in fold(frames).items()]
        if rows:
            yield pd.DataFrame(rows)

    return df.mapInPandas(partial, schema).groupBy(key).applyInPandas(lambda f: pd.DataFrame([{key: k} | s for k, s in fold([f]).items()]), schema)


def nearest_corner(x: Column, y: Column, z: Column, size: int, jitter: Callable[[Column], Column], mixed: Callable[..., Column] | None = None) -> Column:
    """The nearest of the eight corners of a point's grid cell, each moved by a jitter that depends on it alone: (distance, corner), the lowest corner at ties.

    ``mixed`` makes a number that is not negative of a corner's three cell numbers; a hash, if it is not given.
    """
    mixed = mixed or (lambda *cells: F.abs(F.xxhash64(*cells)))
    cells = [F.floor(c / size).cast("long") for c in (x, y, z)]

    def corner(n: int) -> Column:
        steps = [cells[k] + (n >> (2 - k) & 1) for k in range(3)]
        seed = mixed(*steps)
        moved = [s * size + size * jitter(F.shiftright(seed, 8 * k)) for k, s in enumerate(steps)]
        d2 = sum(((a - b) * (a - b) for a, b in zip((x, y, z), moved, strict=True)), F.lit(0.0))
        return F.struct(d2.alias("d2"), F.lit(n).alias("corner"))

    return F.array_min(F.array(*(corner(n) for n in range(8))))


def apply_per_region(df: DataFrame, region: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of the user's own over all rows of each region at once, in one task: a region has to fit into memory."""
    return df.groupBy(region).applyInPandas(function, schema)
