"""Connected components of a graph given as a table of links, without collecting any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root`` (the smallest node reachable) for each node of ``links`` (``u``, ``v``).

    Alternating large-star and small-star rounds: each node hands its neighbours the smallest one it
    knows. A round is two aggregations with map-side minima and two joins. The minima are written before they are
    joined, so both sides of a join are plain exchanges, which adaptive execution splits where one node has very many links. The rounds needed grow with the logarithm of the
    longest chain. Each round ends in a written table, so a lost executor costs one round at most.
    Links of a node to itself, repeated links and an empty table are allowed.
    """
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = _state(now)
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        step = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        smaller = written(step.groupBy("u").agg(F.min("v").alias("m")))
        small = step.join(smaller, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(smaller.select("u", F.col("m").alias("v"))).distinct()
        new = written(small)
        drop_written(links.sparkSession, now, least, step, smaller)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
