"""Numbers: packed coordinates, bit fields, wrapping hashes, colours and levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Start and factor of the hash of three doubles (fixed values).
FNV_START, FNV_FACTOR = 1469598103934665603, 1099511628211


def pack_xz(x: Column, z: Column) -> Column:
    """Two 32-bit coordinates in one long: z above, x below."""
    return F.shiftleft(z.cast("long"), 32).bitwiseOR(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_x(packed: Column) -> Column:
    return F.shiftright(F.shiftleft(packed, 32), 32).cast("int")


def unpack_z(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def section_key(x: Column, z: Column, shift: int) -> Column:
    """The packed key of the section of 2**shift cells that a cell belongs to."""
    return pack_xz(F.shiftright(x, shift), F.shiftright(z, shift))


def signed_byte(i: Column) -> Column:
    """0 to 255 as a signed byte."""
    return F.when(i < 128, i).otherwise(i - 256)


def argb(value: Column) -> Column:
    """(a, r, g, b) of a packed colour."""
    part = lambda n: F.shiftright(value, n).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(part(24).alias("a"), part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def redmean(a: Column, b: Column) -> Column:
    """Squared colour distance weighted by the mean red of two (r, g, b) structs, in 32-bit floats."""
    red = (a["r"] + b["r"]).cast("float") / F.lit(2.0).cast("float")
    dr, dg, db = ((a[k] - b[k]).cast("float") for k in "rgb")
    f = lambda x: F.lit(x).cast("float")
    return ((f(2.0) + red / f(256.0)) * dr * dr + f(4.0) * dg * dg + (f(2.0) + (f(255.0) - red) / f(256.0)) * db * db).cast("float")


def blend(a: Column, b: Column, share: Column) -> Column:
    """The (r, g, b) colour at ``share`` of the way from a to b in 32-bit floats, each part rounded, halves upwards."""
    part = lambda k: (a[k].cast("float") + share.cast("float") * (b[k] - a[k]).cast("float")).cast("float")
    return F.struct(*(F.floor(part(k) + F.lit(0.5).cast("float")).cast("int").alias(k) for k in "rgb"))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def level_or(value: Column, default: Column) -> Column:
    """The default where a level is null or not above zero."""
    return F.when(value.isNull() | (value <= 0), default).otherwise(value)


def falloff(distance: Column, reach: float = 6.0) -> Column:
    """1 at no distance, falling evenly to 0 at ``reach``."""
    return F.when(distance > reach, 0.0).otherwise(1 - distance / reach)


def spread_offset(bits: Column) -> Column:
    """An even draw from -5 to 5 out of 16 random bits."""
    return F.shiftright(bits.bitwiseAND(F.lit(65535)) * 11, 16).cast("int") - 5


def bit_group(draw: Column, n: int, width: int = 12) -> Column:
    """The n-th group of ``width`` bits of a long, lowest first."""
    return F.shiftrightunsigned(draw, n * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def jitter(index: Column) -> Column:
    """The place of a table of 1024 steps from -0.45 to 0.45, by bits 24 to 33 of a long."""
    return (F.shiftright(index, 24).bitwiseAND(F.lit(1023)) - 512) * F.lit(0.9) / 1024.0


def fade(t: Column) -> Column:
    """The quintic that joins gradient noise smoothly."""
    return t * t * t * (t * (t * 6.0 - 15.0) + 10.0)


def octaves(x: Column, base, n: int) -> Column:
    """Sum of ``base`` at n octaves: each of twice the frequency and half the weight of the one before."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda acc, i: acc + base(x * F.pow(F.lit(2.0), i)) * F.pow(F.lit(2.0), -i))


@F.pandas_udf(T.IntegerType())
def spread_hash(keys: pd.Series) -> pd.Series:
    """Multiplication of a long by the golden ratio modulo 2**64, folded to 32 bits; the product wraps."""
    h = keys.to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return pd.Series((h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))


@F.pandas_udf(T.LongType())
def fnv_of_doubles(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    """FNV-style hash over the bits of three doubles, in wrapping 64-bit arithmetic."""
    h = np.full(len(a), FNV_START, np.uint64)
    for s in (a, b, c):
        h = (h ^ s.to_numpy(np.float64).view(np.uint64)) * np.uint64(FNV_FACTOR)
    return pd.Series(h.view(np.int64))


#: Gradients of the noise, in the order of its table (fixed values).
GRADIENTS = ((1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (-1, 0, -1), (0, 1, 1), (0, -1, 1), (0, 1, -1), (0, -1, -1), (1, 1, 0), (0, -1, 1), (-1, 1, 0), (0, -1, -1))


def permutation(seed: int) -> list[int]:
    """The numbers 0 to 255 in an order that depends on a seed."""
    return np.random.default_rng(seed).permutation(256).tolist()


def gradient_noise(x: Column, y: Column, z: Column, table: list[int]) -> Column:
    """Gradient noise of a point: the eight corners of its unit cell, each with a gradient by the table, joined by the quintic fade."""
    lookup = F.array(*map(F.lit, table))
    slopes = F.array(*(F.array(*(F.lit(float(v)) for v in g)) for g in GRADIENTS))
    cell = [F.floor(c).cast("int") for c in (x, y, z)]
    rest = [c - F.floor(c) for c in (x, y, z)]
    at = lambda i: F.get(lookup, F.pmod(i, F.lit(256)))

    def corner(dx: int, dy: int, dz: int) -> Column:
        place = at(at(at(cell[0] + dx) + cell[1] + dy) + cell[2] + dz) % 16
        g = F.get(slopes, place)
        return sum((F.get(g, F.lit(k)) * (rest[k] - d) for k, d in enumerate((dx, dy, dz))), F.lit(0.0))

    fx, fy, fz = (fade(c) for c in rest)
    mix = lambda t, a, b: a + t * (b - a)
    rows = [[mix(fx, corner(0, dy, dz), corner(1, dy, dz)) for dy in (0, 1)] for dz in (0, 1)]
    return mix(fz, *(mix(fy, *r) for r in rows))


#: Numbers that spread the seeds of the generator below (fixed values).
SILVER, GOLDEN = 0x6A09E667F3BCC909, 0x9E3779B97F4A7C15
SPREAD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _spread(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(SPREAD[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SPREAD[1])
    return z ^ (z >> np.uint64(31))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def random_longs(seed: Column, n: int) -> Column:
    """The first n longs of the public generator xoroshiro128++ for each seed, as an array."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def draw(seeds: pd.Series) -> pd.Series:
        start = seeds.to_numpy(np.int64).view(np.uint64) ^ np.uint64(SILVER)
        a, b = _spread(start), _spread(start + np.uint64(GOLDEN))
        out = np.empty((n, len(start)), np.uint64)
        for k in range(n):
            out[k] = _rotated(a + b, 17) + a
            b = b ^ a
            a, b = _rotated(a, 49) ^ b ^ (b << np.uint64(21)), _rotated(b, 28)
        return pd.Series(list(out.T.copy().view(np.int64)))

    return draw(seed)


@F.pandas_udf(T.LongType())
def position_seed(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    """The seed of a position: its coordinates mixed in arithmetic that wraps, x first in 32 bits."""
    a = (x.to_numpy(np.int64) * 3129871).astype(np.int32).astype(np.int64)
    v = a ^ (z.to_numpy(np.int64) * 116129781) ^ y.to_numpy(np.int64)
    u = v.view(np.uint64)
    mixed = u * u * np.uint64(42317861) + u * np.uint64(11)
    return pd.Series(mixed.view(np.int64) >> 16)


def shown(value: Column, decimals: int) -> Column:
    """A number with commas between thousands and so many decimals, halves to the even digit."""
    return F.format_number(value, decimals)


def corners(a: Column, b: Column) -> Column:
    """The lower and the upper one of two coordinates."""
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def fixed_list(values: Column, size: int) -> Column:
    """A list if it has so many elements, else null: the box codec takes six."""
    return F.when(F.size(values) == size, values)
