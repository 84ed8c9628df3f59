"""Durations: showing nanoseconds and reading spans of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of the units; months and years have their mean Gregorian length (fixed values).
SECOND = 1_000_000_000
NANOS = {
    "ns": 1,
    "us": 1_000,
    "ms": 1_000_000,
    "s": SECOND,
    "m": 60 * SECOND,
    "h": 3_600 * SECOND,
    "d": 86_400 * SECOND,
    "w": 604_800 * SECOND,
    "mo": 2_629_746 * SECOND,
    "y": 31_556_952 * SECOND,
}
#: Names by which a unit may be called.
NAMES = {
    "ns": ("ns", "nano", "nanos", "nanosecond", "nanoseconds"),
    "us": ("us", "micro", "micros", "microsecond", "microseconds"),
    "ms": ("ms", "milli", "millis", "millisecond", "milliseconds"),
    "s": ("s", "sec", "secs", "second", "seconds"),
    "m": ("m", "min", "mins", "minute", "minutes"),
    "h": ("h", "hr", "hrs", "hour", "hours"),
    "d": ("d", "day", "days"),
    "w": ("w", "week", "weeks"),
    "mo": ("mo", "month", "months"),
    "y": ("y", "yr", "year", "years"),
}
_STEPS = (("d", " day"), ("h", " hour"), ("m", " minute"), ("s", "s"))


def _two_decimals(value: Column) -> Column:
    """A number from 0.001 to 2**53 with two decimals, rounded as C's ``%.2f`` does: by its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal form half up: 0.125 gives 0.13, and 1.005, which is a little less as a double, 1.01.
    So what is near a tie is rounded in whole numbers.
    """
    whole = F.floor(value)
    part = ((value - whole) * 2.0**62).cast("long")
    low = part.bitwiseAND(F.lit(2**31 - 1)) * 25
    top = F.shiftright(part, 31) * 25 + F.shiftright(low, 31)
    left = top.bitwiseAND(F.lit(2**29 - 1)) * 2**31 + low.bitwiseAND(F.lit(2**31 - 1))
    down = whole * 100 + F.shiftright(top, 29)
    cents = down + ((left > 2**59) | ((left == 2**59) & (down % 2 == 1))).cast("long")
    exact = F.format_string("%d.%02d", F.call_function("div", cents, F.lit(100)), cents % 100)
    return F.when(F.abs(value * 100 - F.floor(value * 100) - 0.5) < 0.001, exact).when(value.isNotNull(), F.format_string("%.2f", value))


def decimal_unit(nanos: Column, largest: str = "d") -> Column:
    """Nanoseconds in their largest unit, ``largest`` at most, with two decimals; below 1000 as they are, then milliseconds up to a second."""
    number = nanos.cast("double")
    value, label = F.when(nanos < SECOND, number / NANOS["ms"]), F.when(nanos < SECOND, "ms")
    for (unit, name), above in zip(reversed(_STEPS), ("m", "h", "d", None), strict=True):
        amount = number / NANOS[unit]
        shown = F.when(amount != 1, name + "s").otherwise(name) if name.startswith(" ") else F.lit(name)
        if unit == largest or not above:
            value, label = value.otherwise(amount), label.otherwise(shown)
            break
        value, label = value.when(nanos < NANOS[above], amount), label.when(nanos < NANOS[above], shown)
    return F.when(nanos < 1000, F.concat(nanos.cast("string"), F.lit("ns"))).otherwise(F.concat(_two_decimals(value), label))


def whole_unit(nanos: Column) -> Column:
    """Nanoseconds (a long or a decimal without fraction) in their largest unit, cut to a whole number; 1000 to 999999 give 0ms."""

    def whole(unit: str) -> Column:
        return F.call_function("div", nanos, F.lit(NANOS[unit]))

    out = F.when(nanos < 1000, F.concat(nanos.cast("string"), F.lit("ns"))).when(nanos < SECOND, F.concat(whole("ms").cast("string"), F.lit("ms")))
    for (unit, label), above in zip(reversed(_STEPS), ("m", "h", "d", None), strict=True):
        value = whole(unit)
        shown = F.concat(value.cast("string"), F.lit(label), F.when(F.lit(label.startswith(" ")) & (value != 1), "s").otherwise(""))
        out = out.when(nanos < NANOS[above], shown) if above else out.otherwise(shown)
    return out


def when_is(target_nanos: Column, now_nanos: Column) -> Column:
    """How far off a moment is: ``in ...`` or ``... ago``."""
    apart = target_nanos - now_nanos
    return F.when(apart < 0, F.concat(whole_unit(-apart), F.lit(" ago"))).otherwise(F.concat(F.lit("in "), whole_unit(apart)))


def _unit(span: Column) -> Column:
    name = F.lower(F.regexp_extract(span, r"^(\d+)\s*([a-zA-Z]+)$", 2))
    out = F.lit(None).cast("string")
    for unit, names in NAMES.items():
        out = F.when(name.isin(*names), unit).otherwise(out)
    return out


def parse_span(span: Column) -> Column:
    """(count, unit) of a span such as ``5 MIN`` or ``2mo``; null for a sign, a fraction or an unknown unit."""
    count = F.regexp_extract(span, r"^(\d{1,18})\s*([a-zA-Z]+)$", 1)
    unit = _unit(span)
    return F.when((count != "") & unit.isNotNull(), F.struct(F.when(count != "", count).cast("long").alias("count"), unit.alias("unit")))


def span_nanos(parsed: Column) -> Column:
    """Nanoseconds of a parsed span."""
    factors = F.create_map(*(x for k, v in NANOS.items() for x in (F.lit(k), F.lit(v).cast("long"))))
    return parsed["count"] * factors[parsed["unit"]]


def shifted(moment: Column, parsed: Column, back: bool = False) -> Column:
    """A timestamp moved by a parsed span, to the microsecond."""
    micros = F.floor(span_nanos(parsed) / 1000).cast("long")
    return F.timestamp_micros(F.unix_micros(moment.cast("timestamp")) + (-micros if back else micros))


def at_most_days(parsed: Column) -> Column:
    """Whether the span's unit is no longer than a day."""
    return parsed["unit"].isin("ns", "us", "ms", "s", "m", "h", "d")
