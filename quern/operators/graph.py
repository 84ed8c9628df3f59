"""Breadth-first search over a table of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def bfs_depths(edges: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """(node, depth) of all nodes within ``limit`` steps of a start. ``edges`` has src and dst, ``starts`` node.

    Each step joins the frontier alone with the edges and drops what was visited before. Frontiers are written,
    so a step's plan holds one join and does not grow with the depth; the search ends where a frontier is empty.
    """
    frontier = written(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = [frontier]
    for depth in range(1, limit + 1):
        reached = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        before = reduce(DataFrame.unionAll, seen)
        frontier = written(reached.join(before, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return reduce(DataFrame.unionAll, seen)
