"""Registered queries of scalar functions over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import numbers as N
from ..functions import text as S
from ..functions import units as U
from ..operators import regions as A
from .registry import query

col, lit = F.col, F.lit


@query("""SELECT p_partkey, lower(w[1]) || array_to_string(list_transform(w[2:], lambda x: upper(x[1:1]) || x[2:]), '') AS camel, CASE WHEN p_type = 'PROMO' THEN 'world' ELSE 'other_world' END AS level
FROM (SELECT p_partkey, p_type, string_split(replace(upper(p_type) || '_' || p_name || '_bAZ', ' ', '_'), '_') AS w FROM part)""")
def snake_and_level(t, spark):
    """Snake case as camel case, and names of levels without a prefix."""
    snake = F.replace(F.concat(F.upper("p_type"), lit("_"), "p_name", lit("_bAZ")), lit(" "), lit("_"))
    level = F.when(col("p_type") == "PROMO", "base_world").otherwise("other_world")
    return t("part").select("p_partkey", S.snake_to_camel(snake).alias("camel"), S.without_prefix(level, "base_").alias("level"))


@query("""WITH n AS (SELECT event_id, (event_id - 400) * 7000000000 AS d FROM events)
SELECT event_id, CASE WHEN d < 0 THEN w || ' ago' ELSE 'in ' || w END AS shown FROM (SELECT event_id, d, CASE WHEN abs(d) < 1000 THEN abs(d) || 'ns' WHEN abs(d) < 60000000000 THEN (abs(d) // 1000000000) || 's'
WHEN abs(d) < 3600000000000 THEN (abs(d) // 60000000000) || ' minute' || (CASE WHEN abs(d) // 60000000000 <> 1 THEN 's' ELSE '' END) WHEN abs(d) < 86400000000000 THEN (abs(d) // 3600000000000) || ' hour' || (CASE WHEN abs(d) // 3600000000000 <> 1 THEN 's' ELSE '' END)
ELSE (abs(d) // 86400000000000) || ' day' || (CASE WHEN abs(d) // 86400000000000 <> 1 THEN 's' ELSE '' END) END AS w FROM n)""")
def target_time(t, spark):
    """How far off a moment is, before or behind."""
    return t("events").select("event_id", U.when_is(col("event_id") * 7_000_000_000, lit(400 * 7_000_000_000).cast("long")).alias("shown"))


@query("""SELECT event_id, ts + to_microseconds((event_id % 5) * 60000000) AS later, ts - to_microseconds((event_id % 5) * 60000000) AS earlier, event_id % 2 = 0 AS short FROM events""")
def moved_time(t, spark):
    """Moments moved by spans, and spans in units no longer than a day."""
    e = col("event_id")
    span = U.parse_span(F.concat((e % 5).cast("string"), lit("min")))
    unit = U.parse_span(F.concat(lit("3"), F.when(e % 2 == 0, "h").otherwise("mo")))
    return t("events").select("event_id", U.shifted(col("ts"), span).cast("timestamp_ntz").alias("later"), U.shifted(col("ts"), span, back=True).cast("timestamp_ntz").alias("earlier"), U.at_most_days(unit).alias("short"))


@query("""WITH c AS (SELECT p_partkey, (p_size / 50.0)::FLOAT AS f, p_partkey * 7 % 256 AS a, p_partkey * 13 % 256 AS b FROM part)
SELECT p_partkey, floor((a::FLOAT + f * (b - a)::FLOAT)::FLOAT + 0.5::FLOAT)::INT AS red FROM c""")
def colour_gradient(t, spark):
    """A colour on the way between two others."""
    k = col("p_partkey")
    a, b = (F.struct(*((k * m % 256).cast("int").alias(c) for c in "rgb")) for m in (7, 13))
    return t("part").withColumns({"a": a, "b": b}).select("p_partkey", N.blend(col("a"), col("b"), (col("p_size") / 50.0).cast("float"))["r"].alias("red"))


_P = N.permutation(7)
_TABLE = "[" + ", ".join(map(str, _P)) + "]"
_GRAD = "[" + ", ".join("[" + ", ".join(f"{v}.0" for v in g) + "]" for g in N.GRADIENTS) + "]"


def _corner_sql(dx: int, dy: int, dz: int) -> str:
    place = f"p[(p[(p[(cx + {dx}) % 256 + 1] + cy + {dy}) % 256 + 1] + cz + {dz}) % 256 + 1] % 16 + 1"
    return f"(g[{place}][1] * (x - cx - {dx}) + g[{place}][2] * (y - cy - {dy}) + g[{place}][3] * (z - cz - {dz}))"


def _mix_sql(t: str, a: str, b: str) -> str:
    return f"({a} + {t} * ({b} - {a}))"


_FADED = [f"(({c} - c{c}) * ({c} - c{c}) * ({c} - c{c}) * (({c} - c{c}) * (({c} - c{c}) * 6 - 15) + 10))" for c in "xyz"]
_NOISE = _mix_sql("fz", *(_mix_sql("fy", *(_mix_sql("fx", f"c{0}{dy}{dz}", f"c{1}{dy}{dz}") for dy in (0, 1))) for dz in (0, 1)))


@query(f"""WITH t AS (SELECT p_partkey, p_size * 0.37::DOUBLE AS x, p_partkey * 0.11::DOUBLE AS y, p_retailprice * 0.013::DOUBLE AS z, {_TABLE} AS p, {_GRAD} AS g FROM part),
c AS (SELECT *, floor(x)::BIGINT AS cx, floor(y)::BIGINT AS cy, floor(z)::BIGINT AS cz FROM t),
n AS (SELECT p_partkey, {_FADED[0]} AS fx, {_FADED[1]} AS fy, {_FADED[2]} AS fz, {", ".join(f"{_corner_sql(a, b, c)} AS c{a}{b}{c}" for a in (0, 1) for b in (0, 1) for c in (0, 1))} FROM c)
SELECT p_partkey, round({_NOISE}, 6) AS noise FROM n""")
def gradient_noise(t, spark):
    """Gradient noise of points."""
    x, y, z = col("p_size") * lit(0.37), col("p_partkey") * lit(0.11), col("p_retailprice") * lit(0.013)
    return t("part").select("p_partkey", F.round(N.gradient_noise(x, y, z, _P), 6).alias("noise"))


_M = "18446744073709551616::HUGEINT"
_SIGNED = f"(CASE WHEN {{v}} >= 9223372036854775808::HUGEINT THEN {{v}} - {_M} ELSE {{v}} END)::BIGINT"


def _times_sql(v: str, factor: int) -> str:
    """A product modulo 2**64, made of two halves that stay below 2**97."""
    return f"((({v}) % 4294967296) * {factor}::HUGEINT + ((({v}) // 4294967296) * {factor}::HUGEINT % 4294967296) * 4294967296) % {_M}"


def _spread_sql(v: str, n: str) -> str:
    first, second = _times_sql(f"xor({v}, {v} // 1073741824)", N.SPREAD[0]), _times_sql(f"xor({n}a, {n}a // 134217728)", N.SPREAD[1])
    return f", {n}1 AS (SELECT *, {first} AS {n}a FROM {{src}}), {n}2 AS (SELECT *, {second} AS {n}b FROM {n}1), {n}3 AS (SELECT *, xor({n}b, {n}b // 2147483648) AS {n} FROM {n}2)"


@query(
    f"""WITH s AS (SELECT c_custkey, xor(c_custkey::HUGEINT, {N.SILVER}::HUGEINT) AS z FROM customer)"""
    + _spread_sql("z", "a").format(src="s")
    + f", y AS (SELECT *, (z + {N.GOLDEN}::HUGEINT) % {_M} AS w FROM a3)"
    + _spread_sql("w", "b").format(src="y")
    + f""", o AS (SELECT c_custkey, a, b, (a + b) % {_M} AS t FROM b3), u AS (SELECT c_custkey, (((t * 131072) % {_M} + t // 140737488355328) + a) % {_M} AS v FROM o)
SELECT c_custkey, {_SIGNED.format(v="v")} AS first FROM u""")
def seeded_longs(t, spark):
    """The first draw of a seeded generator for each key."""
    return t("customer").select("c_custkey", F.get(N.random_longs(col("c_custkey"), 2), lit(0)).alias("first"))


@query(f"""WITH l AS (SELECT c_custkey, xor(xor((c_custkey % 600 * 3129871)::HUGEINT, (c_nationkey * 116129781)::HUGEINT), (c_custkey % 64)::HUGEINT) AS l FROM customer), m AS (SELECT c_custkey, {_SIGNED.format(v=f"((l * l * 42317861 + l * 11) % {_M})")} AS m FROM l)
SELECT c_custkey, CASE WHEN m >= 0 THEN m // 65536 ELSE -((65535 - m) // 65536) END AS seed FROM m""".replace("c_nationkey * 116129781", "c_nationkey::BIGINT * 116129781"))
def position_seeds(t, spark):
    """Seeds of positions."""
    k = col("c_custkey")
    return t("customer").select("c_custkey", N.position_seed(k % 600, k % 64, col("c_nationkey").cast("long")).alias("seed"))


@query("""SELECT p_partkey, '' AS missing, p_name AS name FROM part""")
def string_or_empty(t, spark):
    """A field of a record as a string, empty if it is not there."""
    raw = F.to_json(F.struct("p_name"))
    return t("part").select("p_partkey", *(F.coalesce(F.get_json_object(raw, path), lit("")).alias(n) for n, path in (("missing", "$.other"), ("name", "$.p_name"))))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 6 THEN 21.0 END AS box, (p_partkey + p_size)::BIGINT AS total FROM part""")
def list_codecs(t, spark):
    """Lists of numbers through JSON and back; a box has six numbers or is none."""
    box = F.from_json(F.to_json(F.slice(F.array(*(lit(float(i)) for i in range(1, 8))), lit(1), (col("p_size") % 7).cast("int"))), "array<double>")
    longs = F.from_json(F.to_json(F.array(col("p_partkey"), col("p_size").cast("long"))), "array<long>")
    return t("part").select("p_partkey", F.aggregate(N.fixed_list(box, 6), lit(0.0), lambda a, x: a + x).alias("box"), F.aggregate(longs, lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""SELECT p_partkey, format('{:,.2f}', p_retailprice * 1000) AS two, format('{:,.1f}', p_size / 4.0) AS one, format('{:,}', p_partkey * 1000) AS whole FROM part""".replace("p_size / 4.0", "p_size / 2.0"))
def number_formats(t, spark):
    """Numbers with commas and a fixed number of decimals."""
    return t("part").select("p_partkey", N.shown(col("p_retailprice") * 1000, 2).alias("two"), N.shown(col("p_size") / 2.0, 1).alias("one"), N.shown(col("p_partkey") * 1000, 0).alias("whole"))


@query("""SELECT p_partkey, least(p_size, p_partkey % 50)::BIGINT AS low, greatest(p_size, p_partkey % 50)::BIGINT AS high FROM part""")
def box_corners(t, spark):
    """The corners of a box from two points in any order."""
    return t("part").select("p_partkey", N.corners(col("p_size").cast("long"), col("p_partkey") % 50).alias("c")).select("p_partkey", "c.*")


@query("""SELECT p_partkey, floor(least(p_size * 1.5, p_size * 1.5 - p_partkey % 7))::INT - 2 AS x0, floor(p_partkey * 0.5)::INT - 2 AS z0, floor(p_size * 1.5)::INT + 2 AS x1, floor(p_partkey * 0.5 + 3)::INT + 2 AS z1 FROM part""")
def moving_reach(t, spark):
    """The cells that something moving can touch, with a buffer."""
    k, size = col("p_partkey"), col("p_size")
    return t("part").select("p_partkey", *A.reach(size * lit(1.5), k * lit(0.5), -(k % 7), lit(3), 2))


@query("""SELECT p_partkey, n::INT AS n, dynamic, part FROM part, (VALUES (0, false, 'Part '), (1, true, 'key'), (2, false, ' in <'), (3, true, 'brand'), (4, false, '> <9>')) s(n, dynamic, part)""")
def template_segments(t, spark):
    """A template cut into its static and dynamic parts."""
    return t("part").select("p_partkey", F.posexplode(S.segments(lit("Part <key> in <<brand>> <9>"))).alias("n", "s")).select("p_partkey", "n", "s.dynamic", "s.part")


@query("""SELECT * FROM (VALUES (0, 'max-tick-rate'), (1, 'tps-bar'), (2, 'xml-path')) v(position, name)""")
def property_names(t, spark):
    """The fields of a record in the order in which they are declared, in kebab case."""
    schema = Y.StructType([Y.StructField(n, Y.IntegerType()) for n in ("maxTickRate", "tpsBar", "xmlPath")])
    return spark.createDataFrame(list(enumerate(schema.names)), "position int, raw string").select("position", S.to_kebab(col("raw")).alias("name"))


@query("""SELECT p_partkey, p_size > 25 AS gt, p_size >= 25 AS ge, p_size < 25 AS lt, p_size <= 25 AS le, p_size = 25 AS eq FROM part""")
def number_comparisons(t, spark):
    """A value against a bound in all ways, as 32-bit floats."""
    from ..operators.trees import number_holds

    return t("part").select("p_partkey", *(number_holds(col("p_size"), lit(k), lit(25.0), lit(None).cast("double")).alias(k) for k in ("gt", "ge", "lt", "le", "eq")))


@query("""SELECT p_partkey, -p_size AS mz, 20 - p_partkey AS hx, 6 - p_size AS hz, 10 - 3 + p_size AS tx, 10 + 3 - p_partkey AS tz FROM part""")
def all_turns(t, spark):
    """Points mirrored the other way, and turned half way and three quarters about a pivot."""
    from ..operators.encoding import mirrored_rotated

    k, size = col("p_partkey"), col("p_size")
    _, mz = mirrored_rotated(k, size, "z", 0)
    hx, hz = mirrored_rotated(k, size, "", 180, (10, 3))
    tx, tz = mirrored_rotated(k, size, "", 270, (10, 3))
    return t("part").select("p_partkey", mz.alias("mz"), hx.alias("hx"), hz.alias("hz"), tx.alias("tx"), tz.alias("tz"))
