"""Set operations with a definite result where order matters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_first(frames: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """All rows of the frames, one for each key: of the first frame that has it, least in ``order``."""
    tagged = reduce(lambda a, b: a.unionByName(b), [f.withColumn("__from", F.lit(i)) for i, f in enumerate(frames)])
    return first_seen(tagged, keys, ["__from", order]).drop("__from")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Only a struct minimum for each key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*(c for c in order if c not in keys), *rest)).alias("__b"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__b.{c}").alias(c) for c in df.columns))


def retained(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose keys are in b, repeats included."""
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def removed(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose keys are not in b, repeats included."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def contains_all(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether every key of b is in a."""
    return removed(b, a, keys).agg((F.count("*") == 0).alias("contains_all"))


def bit_set(ordinals: Column) -> Column:
    """A set of ordinals (an array of 0 to 62) as the bits of a long."""
    return F.aggregate(ordinals, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.expr("bigint(1)"), i.cast("int"))))


def has_any(bits: Column, mask: Column) -> Column:
    """Whether two bit sets meet."""
    return bits.bitwiseAND(mask) != 0


def missing_keys(have: Column, required: Column) -> Column:
    return F.array_sort(F.array_except(required, have))


def keys_fit(have: Column, required: Column, allowed: Column) -> Column:
    """Whether all required keys are there and no key beyond the allowed ones is."""
    return (F.size(F.array_except(required, have)) == 0) & (F.size(F.array_except(have, allowed)) == 0)


def with_lag_delta(df: DataFrame, keys: list[str], order: list[str], axes: list[str]) -> DataFrame:
    """Rows that moved since the one before of their key; the first row counts as moved."""
    w = W.partitionBy(*keys).orderBy(*order)
    still = reduce(lambda a, b: a & b, [F.coalesce(F.col(a) == F.lag(a).over(w), F.lit(False)) for a in axes])
    return df.withColumn("__still", still).where(~F.col("__still")).drop("__still")
