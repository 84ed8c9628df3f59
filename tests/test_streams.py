"""Streams over files, batch by batch, against the same in plain Python."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from quern.streaming import state as ST

T0 = datetime.datetime(2024, 1, 1)


def at(minutes: float) -> datetime.datetime:
    return T0 + datetime.timedelta(minutes=minutes)


@pytest.fixture()
def feed(spark, tmp_path):
    """A function that makes a stream of one file for each list of rows, read in turn."""

    def made(name, schema, *batches):
        folder = tmp_path / name
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}")
            time.sleep(1.1)  # files are read in the order of their times
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}")

    return made


def rows_of(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert not q.isActive
    return spark.table(name).collect()


def test_sliding_means(spark, feed):
    """Late rows count until the watermark has passed their windows, which takes effect a batch later, and not after."""
    stream = feed("slide", "k string, ts timestamp_ntz, v double", [("a", at(0.5), 1.0), ("a", at(4.5), 3.0)], [("a", at(30), 10.0)], [("b", at(30), 0.0)], [("a", at(1), 100.0), ("a", at(29), 20.0)])
    got = {(r.k, r.start): (r["mean"], r.n) for r in rows_of(spark, ST.sliding_means(stream, "k", "ts", "v"), "slides", "update")}
    assert got[("a", at(0))] == (2.0, 2) and got[("a", at(4))] == (3.0, 1)
    assert got[("a", at(29))] == (15.0, 2) and got[("a", at(30))] == (10.0, 1)


def test_tumbling_and_sessions(spark, feed):
    rows = [("a", at(0), 1.0), ("a", at(3), 1.0), ("a", at(20), 1.0), ("b", at(1), 1.0)]
    end = [("z", at(500), 0.0)]
    got = sorted((r.k, r.start, r.n) for r in rows_of(spark, ST.tumbling_counts(feed("tumble", "k string, ts timestamp_ntz, v double", rows, end, end), "k", "ts", "10 minutes", "1 minute"), "tumbles", "append") if r.k != "z")
    assert got == [("a", at(0), 2), ("a", at(20), 1), ("b", at(0), 1)]
    got = sorted((r.k, r.start, r.end, r.n) for r in rows_of(spark, ST.session_counts(feed("session", "k string, ts timestamp_ntz, v double", rows, end, end), "k", "ts", "5 minutes", "1 minute"), "sessions", "append") if r.k != "z")
    assert got == [("a", at(0), at(8), 2), ("a", at(20), at(25), 1), ("b", at(1), at(6), 1)]


def test_stream_join(spark, feed):
    """Pairs of one key that are no further apart than the reach, each once."""
    left = feed("left", "k string, ts timestamp_ntz, a int", [("x", at(0), 1), ("y", at(0), 2)], [("x", at(30), 3)])
    right = feed("right", "k string, ts timestamp_ntz, b int", [("x", at(4), 10)], [("x", at(31), 30), ("y", at(6), 20)])
    got = sorted((r.k, r.a, r.b) for r in rows_of(spark, ST.joined_within(left, right, "k", "ts", "5 minutes", "10 minutes"), "joins", "append"))
    assert got == [("x", 1, 10), ("x", 3, 30)]


def test_ewma_rounds_towards_zero(spark, feed):
    stream = feed("ewma", "k string, n int, v long", [("a", 1, -10), ("a", 2, 3)], [("a", 3, -5)])
    seen, old = [], 0
    for x in (-10, 3, -5):
        old = int((old * 3 + x) / 4)
        seen.append(old)
    q = ST.ewma_stream(stream, "k", "v", "n").writeStream.outputMode("update").format("memory").queryName("ewmas").start()
    until = time.time() + 60
    while spark.table("ewmas").count() < 2 and time.time() < until:
        time.sleep(0.3)
    q.stop()
    assert [r.ewma for r in spark.table("ewmas").collect()] == seen[1:]


def test_expiring_stream(spark, feed):
    """A value lives until its time has run out; a null clears it at once."""
    stream = feed("expire", "k string, v string", [("a", "1"), ("b", "2")], [("b", None)])
    q = ST.expiring_stream(stream, "k", "v", 2_000).writeStream.outputMode("update").format("memory").queryName("expired").start()
    until = time.time() + 60
    while spark.table("expired").where("key = 'a' and not alive").count() < 1 and time.time() < until:
        time.sleep(0.5)
    q.stop()
    got = [(r.key, r.value, r.alive) for r in spark.table("expired").collect()]
    assert [x for x in got if x[0] == "a"] == [("a", "1", True), ("a", "1", False)]
    assert [x for x in got if x[0] == "b"] == [("b", "2", True), ("b", None, False)]


def test_throttled(spark, feed):
    """Batches reach the sink no oftener than once in the given time."""
    stream = feed("throttle", "k string, v int", [("a", 1)], [("a", 2)], [("a", 3)])
    seen: list[tuple[float, int]] = []
    q = ST.throttled(stream, lambda df, i: seen.append((time.time(), df.agg(F.sum("v")).first()[0])), seconds=2)
    until = time.time() + 60
    while len(seen) < 3 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert sorted(v for _, v in seen) == [1, 2, 3]
    assert seen[2][0] - seen[1][0] >= 1.0
