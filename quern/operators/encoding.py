"""Dictionary codes and bit packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def dictionary(df: DataFrame, column: str, position: str) -> DataFrame:
    """(value, code): the distinct values numbered from 0 by first position, and by value where positions tie.

    The distinct values are sorted in ranges and numbered range by range, so no task holds all of them; one count
    for each range is broadcast.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = df.groupBy(column).agg(F.min(position).alias("first"))
    ranged = written(first.repartitionByRange(n, "first", column).withColumn("part", F.spark_partition_id()))
    before = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(before, F.lit(0)))
    placed = ranged.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("first", column)) - 1)
    return placed.join(F.broadcast(sizes), "part").select(column, (F.col("at") + F.col("before")).cast("int").alias("code"))


def bits_for(top: Column) -> Column:
    """Bits that hold the numbers from 0 to ``top``; at least one."""
    return F.greatest(F.lit(1), F.length(F.bin(top))).cast("int")


def pack(values: list[tuple[Column, int]]) -> Column:
    """Fields of the given widths in one long, the first one lowest. More than 63 bits or a negative value is an error."""
    if sum(w for _, w in values) > 63:
        raise ValueError("the fields need more bits than a long has")
    out, at = F.lit(0).cast("long"), 0
    for v, width in values:
        v = v.cast("long")
        checked = F.when((v >= 0) & (v < (1 << width)), v).otherwise(F.raise_error(F.lit("a value does not fit its field")).cast("long"))
        out, at = out.bitwiseOR(F.shiftleft(checked, at)), at + width
    return out


def unpack(packed: Column, widths: list[int]) -> list[Column]:
    """The fields of ``pack`` in the same order."""
    out, at = [], 0
    for width in widths:
        out.append(F.shiftrightunsigned(packed, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return out


def widths_of(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Bits for each column by its maximum: one row reaches the driver."""
    row = df.agg(*(bits_for(F.coalesce(F.max(c), F.lit(0)).cast("long")).alias(c) for c in columns)).first()
    return row.asDict()


def mirrored_rotated(x: Column, z: Column, mirror: str, rotation: int, pivot: tuple[int, int] = (0, 0)) -> tuple[Column, Column]:
    """A point mirrored (``x``, ``z`` or none) and then turned by a multiple of 90 degrees clockwise about a pivot."""
    x, z = (-x if mirror == "x" else x), (-z if mirror == "z" else z)
    px, pz = pivot
    return {0: (x, z), 90: (px + pz - z, pz - px + x), 180: (2 * px - x, 2 * pz - z), 270: (px - pz + z, px + pz - x)}[rotation % 360]
