"""Counts and totals: by type, by level of a hierarchy, under caps, and mergeable states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_counts(df: DataFrame, levels: list[str], value: Column | None = None, name: str = "n") -> DataFrame:
    """Totals at each level of a hierarchy and over all; ``level`` is the number of levels that a row keeps.

    Groups without anything are left out. Counts come from one aggregation with partial sums.
    """
    grouping = sum((1 - F.grouping(c) for c in levels), F.lit(0)).cast("int")
    out = df.rollup(*levels).agg(F.sum(F.lit(1) if value is None else value).cast("long").alias(name), grouping.alias("level"))
    return out.where(F.col(name) > 0)


def counts_by_type(df: DataFrame, kind: str, number: str, amount: str | None = None) -> DataFrame:
    """Count by type; a type without a name counts as unknown[number]."""
    label = F.coalesce(F.col(kind), F.concat(F.lit("unknown["), F.col(number).cast("string"), F.lit("]")))
    return df.groupBy(label.alias("type")).agg((F.sum(amount) if amount else F.count("*")).cast("long").alias("n"))


def by_region(df: DataFrame, region: str, total: str) -> DataFrame:
    """Cells grouped by region without the empty ones; those without a region form a group of their own, reported as 0."""
    full = df.where(F.col(total) > 0).withColumn("no_region", F.col(region).isNull())
    return full.groupBy(F.coalesce(F.col(region), F.lit(0)).alias("region"), "no_region").agg(F.count("*").alias("cells"), F.sum(total).cast("long").alias("total"))


def capped(count: Column, limit: Column) -> Column:
    """A count that stops at its limit."""
    return F.least(count, limit)


def spawn_cap(limit: Column, cells: Column, unit: int) -> Column:
    """limit x cells / unit in whole numbers."""
    return F.floor(limit * cells / unit).cast("long")


def room_left(df: DataFrame, keys: list[str], kind: str, limit: str, count: str) -> DataFrame:
    """For each key the least room (limit less count) and the kind that has it; the first kind by name wins ties."""
    room = F.struct((F.col(limit) - F.col(count)).alias("room"), F.col(kind).alias("kind"))
    return df.groupBy(*keys).agg(F.min(room).alias("m")).select(*keys, F.col("m.room").alias("room"), F.col("m.kind").alias("kind"))


def quorum(share: Column, total: Column, percent: float) -> Column:
    """Whether enough of all are in a state: at least one, and no less than the percentage, rounded up."""
    return share >= F.greatest(F.lit(1), F.ceil(total * percent / 100))


def fill_state(used: Column, size: Column) -> Column:
    """0 if every slot of a group is empty, 2 if every slot is full, else 1."""
    return F.when(F.bool_and(used <= 0), 0).when(F.bool_and(used >= size), 2).otherwise(1)


def percent_used(used: Column, top: Column) -> Column:
    """Share of a maximum in percent, from 0 to 100; 0 if there is no maximum."""
    return F.when(top <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), used * 100.0 / top)))


def merged_states(df: DataFrame, keys: list[str], total: str, age: str) -> DataFrame:
    """States of one key merged: amounts add up, the youngest age stays."""
    return df.groupBy(*keys).agg(F.sum(total).alias(total), F.min(age).alias(age), F.count("*").alias("parts"))


def merge_regions(state: DataFrame, moves: DataFrame, region: str, deadline: str, value: str) -> DataFrame:
    """Regions merged into others: (source, target, tick_source, tick_target) in ``moves``; deadlines shift by the
    difference of the ticks, values add up, the earliest deadline stays."""
    joined = state.join(moves, state[region] == moves["source"], "left")
    to = F.coalesce("target", region)
    shifted = F.col(deadline) + F.coalesce(F.col("tick_target") - F.col("tick_source"), F.lit(0))
    return joined.select(to.alias(region), shifted.alias(deadline), value).groupBy(region).agg(F.min(deadline).alias(deadline), F.sum(value).alias(value))


def split_regions(state: DataFrame, sections: DataFrame, key: str, region: str) -> DataFrame:
    """States dealt to the regions that their sections belong to now; states of sections without a region go."""
    return state.drop(region).join(sections.select(key, region), key)


def duration_summary(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Least, greatest, mean, median and the given percentiles of a duration for each key, interpolated between neighbours."""
    exact = [F.percentile(value, p).alias(n) for n, p in {"median": 0.5, **shares}.items()]
    return df.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"), *exact)


def neighbour_levels(cells: DataFrame, key: str, x: str, z: str, level: str, source: str, drop: int) -> DataFrame:
    """For each cell the level that flows in: two or more sources beside it leave it as it is (null), else the highest level of
    its four neighbours less ``drop``, 0 at least. Cells meet their neighbours by equality of shifted places."""
    beside = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    sent = cells.withColumn("o", F.explode(beside)).select((F.col(x) + F.col("o.i")).alias(x), (F.col(z) + F.col("o.j")).alias(z), F.col(level).alias("__l"), F.col(source).alias("__s"))
    seen = sent.groupBy(x, z).agg(F.max("__l").alias("top"), F.count_if("__s").alias("sources"))
    both = cells.join(seen, [x, z], "left")
    flows = F.greatest(F.coalesce("top", F.lit(0)) - drop, F.lit(0))
    return both.select(key, F.coalesce("sources", F.lit(0)).alias("sources"), F.when(F.coalesce("sources", F.lit(0)) < 2, flows).alias("flows"))


def weighted_kinds(df: DataFrame, key: str, kind: str, value: Column, weights: dict[str, float]) -> DataFrame:
    """The sum of contributions of each key, each with the weight of its kind; unknown kinds count for nothing."""
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in weights.items() for v in kv)), F.col(kind)), F.lit(0.0))
    return df.groupBy(key).agg(F.sum(value * weight).alias("total"))
