"""Scans of a world: labels of regions, counts of one region, rules by world, dense layers of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Id of a region that is not known.
NO_REGION = -1


def region_label(world: Column, region: Column, x: Column, z: Column) -> Column:
    """A region's name by its world and centre; regions without an id are unknown."""
    known = F.concat(world, F.lit(" region at "), x.cast("string"), F.lit(", "), z.cast("string"))
    return F.when(F.coalesce(region, F.lit(NO_REGION)) == NO_REGION, F.concat(world, F.lit(" [region=unknown]"))).otherwise(known)


def one_region_counts(cells: DataFrame, region: str, number: int | None, counts: dict[str, Column]) -> DataFrame:
    """One row with the counts of one region's cells. Without a number (work that belongs to no region) all are 0."""
    own = cells.where(F.col(region) == number) if number is not None else cells.limit(0)
    return own.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()))


def rules_by_world(df: DataFrame, rule: str, world: str, value: str) -> DataFrame:
    """(rule, default, by_world): a map of each rule's values by world, and its value in the first world of all, null if that has none."""
    first = df.agg(F.min(world).alias("w")).first()["w"]
    grouped = df.groupBy(rule).agg(F.map_from_entries(F.collect_list(F.struct(world, value))).alias("by_world"))
    return grouped.select(rule, F.try_element_at("by_world", F.lit(first)).alias("default"), "by_world")


def pack_source(source: Column) -> Column:
    """A source's name in lower case without underscores."""
    return F.replace(F.lower(source), F.lit("_"), F.lit(""))


def dense_layers(df: DataFrame, keys: list[str], index: str, value: str, size: int) -> DataFrame:
    """(keys, layers): an array of ``size`` places for each key, null where nothing is; of several values the least."""
    at = F.collect_list(F.struct(F.col(index).cast("int").alias("i"), F.col(value).alias("v")))
    each = df.groupBy(*keys, index).agg(F.min(value).alias(value)).groupBy(*keys).agg(F.map_from_entries(at).alias("m"))
    return each.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("m", i)).alias("layers"))


def layer_scan(layers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, index, value) of all places that are filled."""
    return layers.select(*keys, F.posexplode("layers").alias("index", "value")).where("value is not null")


def layer_lookup(layers: DataFrame, wanted: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The rows of ``wanted`` with the value at their key and index; null where a key is unknown or an index out of range."""
    return wanted.join(layers, keys, "left").withColumn("value", F.get("layers", F.col(index).cast("int"))).drop("layers")


def layer_map(layers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cells): a map of index to value of the filled places."""
    pairs = F.transform("layers", lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return layers.select(*keys, F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("cells"))
