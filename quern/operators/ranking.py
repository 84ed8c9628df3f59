"""First and best rows with a definite order: every ordering ends in a tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_k(df: DataFrame, order: list[Column], tie: str, k: int) -> DataFrame:
    """The k first rows; planned as one top-k in each task and a merge."""
    return df.orderBy(*order, tie).limit(k)


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], tie: list[str], k: int, place: str = "place") -> DataFrame:
    """The k first rows of each key with their place from 1. Spark drops rows beyond k before the shuffle as well."""
    return df.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order, *tie))).where(F.col(place) <= k)


def arg_least(df: DataFrame, keys: list[str], by: list[str], keep: list[str]) -> DataFrame:
    """For each key the row that is least in ``by`` (its last column breaks ties), as an aggregation without a sort."""
    best = F.min(F.struct(*by, *(c for c in keep if c not in by))).alias("best")
    grouped = df.groupBy(*keys).agg(best) if keys else df.agg(best)
    return grouped.select(*keys, *(F.col(f"best.{c}").alias(c) for c in dict.fromkeys([*by, *keep]) if c not in keys))


def nearest_of(df: DataFrame, candidates: list[tuple], distance, name: str = "nearest", start: int = 0, unless: Column | None = None) -> DataFrame:
    """The index of the nearest of a fixed list of candidates from ``start`` on; the lowest index wins ties, and where ``unless`` holds it is 0.

    ``distance`` maps a candidate to a column.
    """
    each = F.array(*(F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(candidates) if i >= start))
    best = F.array_min(each)["i"]
    return df.withColumn(name, best if unless is None else F.when(unless, 0).otherwise(best))


def shuffle_key(key: Column, seed: int) -> Column:
    """A number from 0 to 2**32 - 1 that looks random but depends on a whole-number key and a seed alone."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(1 << 31)) * 2654435761 + seed * 40503, F.lit(1 << 32))


def shuffled_by_priority(df: DataFrame, priority: str, key: str, seed: int) -> DataFrame:
    """Highest priority first; within one, an order that looks random but depends on key and seed alone."""
    return df.orderBy(F.desc(priority), shuffle_key(F.col(key), seed), key)


def shuffled_first(df: DataFrame, keys: list[str], test: Column, key: str, seed: int) -> DataFrame:
    """For each of ``keys`` the first row in shuffled order that passes the test."""
    return top_k_per_key(df.where(test), keys, [shuffle_key(F.col(key), seed)], [key], 1).drop("place")


def global_least(df: DataFrame, queue: str, by: list[str], keep: list[str]) -> DataFrame:
    """The least row over all queues; of queues that tie in ``by`` the first one has it."""
    return arg_least(df, [], [*by, queue], keep)


def ordered_by_list(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows in the order in which their values stand in a list; others come last, by value."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return df.orderBy(F.when(at > 0, at).otherwise(len(names) + 1), column)


def first_match(df: DataFrame, test: Column, order: list[Column], tie: str) -> DataFrame:
    """The first row that passes the test."""
    return first_k(df.where(test), order, tie, 1)
