"""Configuration trees as rows (path, is_mapping, value): difference, overlay, defaults, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _below_removed(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose path lies under a path of ``gone``, found by equality on their ancestors."""
    parts = F.split("path", r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    each = df.where(F.size(parts) > 1).select("path", F.explode(ancestors).alias("ancestor"))
    return each.join(gone.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").select("path").distinct()


def tree_diff(actual: DataFrame, schema: DataFrame) -> DataFrame:
    """The changes (path, change) that turn ``actual`` into the shape of ``schema``, in the order in which they apply.

    A path that only the schema has is an ADD, one that only ``actual`` has a REMOVE, and one that is a
    mapping on one side only a REMOVE and an ADD. Values are not compared. Whole subtrees change at their
    top: nothing below a changed path is listed.
    """
    a = actual.select("path", F.col("is_mapping").alias("a"))
    b = schema.select("path", F.col("is_mapping").alias("b"))
    both = a.join(b, "path", "full_outer")
    kinds = F.when(F.col("a").isNull(), F.array(F.lit("ADD"))).when(F.col("b").isNull(), F.array(F.lit("REMOVE"))).when(F.col("a") != F.col("b"), F.array(F.lit("REMOVE"), F.lit("ADD")))
    changed = both.select("path", kinds.alias("kinds")).where(F.col("kinds").isNotNull())
    top = changed.join(_below_removed(changed, changed), "path", "left_anti")
    return top.select("path", F.posexplode("kinds").alias("step", "change"))


def overlay(base: DataFrame, patch: DataFrame) -> DataFrame:
    """``base`` with the values that the patch gives for its paths; paths unknown to ``base`` are ignored. An empty patch gives ``base``."""
    p = patch.select("path", F.col("value").alias("__p"), F.lit(True).alias("__in"))
    return base.join(p, "path", "left").withColumn("value", F.when(F.col("__in"), F.col("__p")).otherwise(F.col("value"))).select(base.columns)


def unknown_paths(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Paths of the patch that ``base`` lacks: those that the overlay warns about."""
    return patch.join(base.select("path"), "path", "left_anti").select("path")


def with_defaults(actual: DataFrame, schema: DataFrame) -> DataFrame:
    """The paths of the schema with the values that ``actual`` has, and the schema's own elsewhere."""
    return overlay(schema, actual)


def glob_to_regex(glob: Column) -> Column:
    """A dotted glob as a regular expression: * stands for one part, ** for any number."""
    quoted = F.regexp_replace(glob, r"([.+?^$()\[\]{}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^.]*")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def without_hidden(tree: DataFrame, globs: list[str]) -> DataFrame:
    """The tree without the paths that match a glob, or lie under one."""
    for g in globs:
        pattern = F.concat(F.rtrim(F.regexp_replace(glob_to_regex(F.lit(g)), r"\$$", "")), F.lit(r"(\..*)?$"))
        tree = tree.where(~F.call_function("rlike", F.col("path"), pattern))
    return tree


def number_holds(value: Column, kind: Column, low: Column, high: Column) -> Column:
    """Whether a number meets its rule, compared as 32-bit floats: gt, ge, lt, le, eq against ``low``, or between both, ends included. Null fails."""
    v, lo, hi = (x.cast("float") for x in (value, low, high))
    test = F.when(kind == "gt", v > lo).when(kind == "ge", v >= lo).when(kind == "lt", v < lo).when(kind == "le", v <= lo).when(kind == "eq", v == lo).when(kind == "between", v.between(lo, hi))
    return F.coalesce(test, F.lit(False))


def violations(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values (path, value) that break a rule (path, kind, lo, hi), with the rule. Every array element counts by itself."""
    return values.join(rules, "path").where(~number_holds(F.col("value").try_cast("double"), F.col("kind"), F.col("lo"), F.col("hi"))).select("path", "value", "kind")
