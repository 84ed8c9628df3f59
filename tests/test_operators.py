"""Operators by hand-worked values, sources and streams."""

import time

import pytest
from pyspark.sql import functions as F

from quern.functions import numbers as N
from quern.functions import text as S
from quern.functions import units as U
from quern.operators import encoding as E
from quern.operators import series as T
from quern.operators import sets as H
from quern.operators import spatial as P
from quern.operators import trees as D
from quern.sources import config as SRC
from quern.streaming import state as ST


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_packing(spark):
    r = one(spark, N.pack_xz(F.lit(-5), F.lit(-2)).alias("p"))
    assert r.p == -4294967301
    r = one(spark, N.unpack_x(F.lit(-4294967301)).alias("x"), N.unpack_z(F.lit(-4294967301)).alias("z"), N.signed_byte(F.lit(127)).alias("a"), N.signed_byte(F.lit(128)).alias("b"), N.signed_byte(F.lit(200)).alias("c"))
    assert tuple(r) == (-5, -2, 127, -128, -56)
    with pytest.raises(ValueError):
        E.pack([(F.lit(1), 40), (F.lit(1), 30)])


@pytest.mark.parametrize("f,given,wanted", [
    (S.capitalize, "heLLo wORLD", "HeLLo wORLD"),
    (S.snake_to_camel, "FOO_bar_bAZ", "fooBarBAZ"),
    (S.to_kebab, "enableTpsBar", "enable-tps-bar"),
    (S.to_kebab, "mc94054", "mc94054"),
    (S.to_kebab, "fooXMLBar", "foo-xml-bar"),
    (S.kebab_to_camel, "foo-bar", "fooBar"),
    (lambda c: S.without_prefix(c, "base_"), "base_world", "world"),
    (lambda c: F.array_join(S.wrap_words(c, 8), "|"), "aa bb cc dddddddddd e", "aa bb cc|dddddddddd|e"),
])
def test_text(spark, f, given, wanted):
    assert one(spark, f(F.lit(given)))[0] == wanted


@pytest.mark.parametrize("nanos,whole", [(999, "999ns"), (1000, "0ms"), (1999999999, "1s"), (60000000000, "1 minute"), (7200000000000, "2 hours"), (86400000000000, "1 day")])
def test_whole_units(spark, nanos, whole):
    assert one(spark, U.whole_unit(F.lit(nanos).cast("long")))[0] == whole


@pytest.mark.parametrize("nanos,whole", [(86_400 * U.SECOND * 100_000 - 1, "99999 days"), (86_400 * U.SECOND * 100_000, "100000 days"), (2**63 - 1, "106751 days")])
def test_whole_units_are_not_rounded_up(spark, nanos, whole):
    assert one(spark, U.whole_unit(F.lit(nanos).cast("long")))[0] == whole


def test_decimal_units_round_as_printf(spark):
    ties = [125_000 * k for k in range(1, 400)] + [5_000 * k for k in range(1, 400)] + [300_000_000 * k for k in range(201, 600)] + [125_000_000 * k for k in range(8, 480)]
    nanos = ties + [1000, 999_999_999, 59_999_999_999, 3_599_999_999_999] + [k * k * 7_919 + 1000 for k in range(1, 20_000, 37)]
    got = spark.createDataFrame([(n,) for n in nanos], "n long").select("n", U.decimal_unit(F.col("n"), largest="m").alias("s")).collect()
    for n, s in got:
        value, unit = (n / 1e6, "ms") if n < 10**9 else (n / 1e9, "s") if n < 6 * 10**10 else (n / 6e10, " minute" if n == 6 * 10**10 else " minutes")
        assert s == "%.2f" % value + unit
    r = one(spark, U.decimal_unit(F.lit(5_400 * U.SECOND)), U.decimal_unit(F.lit(5_400 * U.SECOND), largest="m"), U.decimal_unit(F.lit(36 * 3_600 * U.SECOND)), U.decimal_unit(F.lit(None).cast("long")))
    assert tuple(r) == ("1.50 hours", "90.00 minutes", "1.50 days", None)


def test_spans(spark):
    rows = spark.createDataFrame([("5 MIN",), ("2mo",), ("-1s",), ("1.5s",), ("3 parsecs",)], "s string").select(U.parse_span(F.col("s")).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in rows] == [(5, "m"), (2, "mo"), None, None, None]
    assert one(spark, U.when_is(F.lit(5).cast("long"), F.lit(3_000_000_005).cast("long")))[0] == "3s ago"


def test_segments(spark):
    got = one(spark, S.segments(F.lit("TPS: <tps> of <top>!")))[0]
    assert [tuple(x) for x in got] == [(False, "TPS: "), (True, "tps"), (False, " of "), (True, "top"), (False, "!")]


def test_average(spark):
    steps = [one(spark, T.integer_ewma(F.array(*map(F.lit, [10, 20, 30][:n]))))[0] for n in (1, 2, 3)]
    assert steps == [2, 6, 12]


def test_default_rate(spark):
    none = spark.createDataFrame([], "h string, v double")
    assert T.mean_of_means(none, "h", "v").first().mean == 20.0


def test_strict_reach(spark):
    a = spark.createDataFrame([(1, 0.0)], "k int, x double")
    b = spark.createDataFrame([(5.0,)], "x double")
    assert P.within_reach(a, b, ["x"], 5.0, "k").count() == 0
    assert P.within_reach(a, b, ["x"], 5.0, "k", strict=False).count() == 1
    assert P.within_reach(a, b, ["x"], -1.0, "k").count() == 1
    assert P.within_reach(a, b.limit(0), ["x"], -1.0, "k", how="anti").count() == 1


def tree(spark, rows):
    return spark.createDataFrame([(p, v is None, v) for p, v in rows], "path string, is_mapping boolean, value string")


def test_trees(spark):
    file, schema = tree(spark, [("a", "1"), ("b", "2"), ("m", None), ("m.x", "1")]), tree(spark, [("b", "9"), ("c", "3"), ("m", "4"), ("n", None), ("n.y", "1")])
    got = sorted((r.path, r.step, r.change) for r in D.tree_diff(file, schema).collect())
    assert got == [("a", 0, "REMOVE"), ("c", 0, "ADD"), ("m", 0, "REMOVE"), ("m", 1, "ADD"), ("n", 0, "ADD")]
    over = {r.path: r.value for r in D.overlay(tree(spark, [("a", "1")]), tree(spark, [("a", "2"), ("z", "9")])).collect()}
    assert over == {"a": "2"}


def test_sets(spark):
    a, b = (spark.createDataFrame([(k, v) for k, v in rows], "k int, o int") for rows in ([(1, 5), (1, 3), (2, 1)], [(2, 0), (3, 7)]))
    assert sorted(map(tuple, H.union_first([a, b], ["k"], "o").collect())) == [(1, 3), (2, 1), (3, 7)]


def test_sources(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yml").write_text("top:\n  x: 1\n  list: [1, 2]\nflag: true\n")
    (tmp_path / "b.properties").write_text("# comment\nkey=va=lue\nother : 2\n")
    got = {r.path: (r.is_mapping, r.value) for r in SRC.read_yaml(spark, f"{tmp_path}/a.yml").collect()}
    assert got == {"top": (True, None), "top.x": (False, "1"), "top.list": (False, "[1, 2]"), "flag": (False, "true")}
    props = SRC.read_properties(spark, f"{tmp_path}/b.properties")
    assert sorted((r.path, r.value) for r in props.collect()) == [("key", "va=lue"), ("other", "2")]
    assert '"key":"va=lue"' in SRC.as_json(props).first().json
    SRC.write_lines(props, f"{tmp_path}/out", header="made here")
    SRC.write_lines(props.limit(0), f"{tmp_path}/out", if_missing=True)
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["# made here", "key: va=lue", "other: 2"]
    assert SRC.old_files(spark, str(tmp_path), "*.yml").count() == 1
    (tmp_path / "cpu").write_text("processor\t: 0\nmodel name\t: X\n\nprocessor\t: 1\n")
    assert SRC.cpu_topology(spark, f"{tmp_path}/cpu").count() == 3


def run_stream(spark, df, name, n):
    """The rows in the memory sink once there are n; time-outs keep such a query from ever being idle."""
    q = df.writeStream.outputMode("update").format("memory").queryName(name).start()
    until = time.time() + 100
    while spark.table(name).count() < n and q.isActive and time.time() < until:
        time.sleep(0.5)
    q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([("a", 1, 10), ("a", 1, 20), ("a", 2, 30), ("b", 1, 4)], "k string, tick long, v long")
    data.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    got = {r.key: r.ewma for r in run_stream(spark, ST.ewma_stream(stream(), "k", "v", "v"), "ewma", 2).collect()}
    assert got == {"a": 12, "b": 1}
    got = {(r.key, r.tick): (r.passed, r.over) for r in run_stream(spark, ST.rate_limit_stream(stream(), "k", "tick", 1), "rates", 3).collect()}
    assert got == {("a", 1): (1, 1), ("a", 2): (1, 0), ("b", 1): (1, 0)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tags(spark, tmp_path):
    from quern.sources import tags as G

    tree = {"DataVersion": (G.INT, 7), "a": (G.STRING, "é"), "l": (G.LIST, (G.SHORT, [1, -2])), "n": (G.COMPOUND, {"d": (G.DOUBLE, 1.5), "i": (G.INTS, [3]), "q": (G.LONGS, []), "b": (G.BYTES, [-1])})}
    for zipped in (True, False):
        assert G.parse(G.serialise("root", tree, zipped)) == ("root", tree)
    moved = G.gathered(tree, "data")
    assert set(moved) == {"DataVersion", "data"} and G.gathered(moved, "data") is moved
    (tmp_path / "x.dat").write_bytes(G.serialise("root", tree))
    got = {r.path: r.value for r in G.read_tags(spark, str(tmp_path)).collect()}
    assert got["a"] == "é" and got["n.d"] == "1.5" and got["l"] == "[2, [1, -2]]" and len(got) == 7
