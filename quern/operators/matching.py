"""Matching that depends on an order: one-to-one greedy matching and attachable ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Opposite directions (fixed values).
OPPOSITE = {"up": "down", "down": "up", "north": "south", "south": "north", "east": "west", "west": "east"}


def attachable(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ends (id, front, top, joint, name, target): b's name is a's target, fronts are opposite, and tops are equal unless a's joint rolls."""
    left = a.select(*(F.col(c).alias(f"a_{c}") for c in ("id", "front", "top", "joint", "target")))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in ("id", "front", "top", "name")))
    opposite = F.create_map(*(F.lit(x) for kv in OPPOSITE.items() for x in kv))
    test = (left.a_target == right.b_name) & (opposite[left.a_front] == right.b_front) & ((left.a_joint == "rollable") | (left.a_top == right.b_top))
    return left.join(right, test).select("a_id", "b_id")


def greedy_matches(df: DataFrame, key: str, items: str, slots: str) -> DataFrame:
    """(key, matches): whether every slot (an array of arrays of accepted items) takes an item of its own, first fit in order, and none is left over."""

    def fits(have: list, wanted: list) -> bool:
        free = list(have)
        for accepted in wanted:
            hit = next((x for x in free if x in set(accepted)), None)
            if hit is None:
                return False
            free.remove(hit)
        return not free

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "matches": [fits(x, y) for x, y in zip(f[items], f[slots], strict=True)]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, items, slots).mapInPandas(run, f"{key} {kind}, matches boolean")
