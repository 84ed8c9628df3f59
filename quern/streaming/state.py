"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_means(stream: DataFrame, handle: str, ts: str, value: str, length: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Means over sliding windows with a watermark; late rows beyond it are dropped."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = timed.groupBy(F.window("__ts", length, slide), F.col(handle)).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(handle, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "n")


def ewma_stream(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The running (3 x old + new) / 4 of each key, in whole numbers rounded towards zero; one row for each key and batch, whose rows count in ``order``."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else 0
        for f in frames:
            for x in f.sort_values("__order")["__value"]:
                total = old * 3 + int(x)
                old = total // 4 if total >= 0 else -(-total // 4)
        state.update((old,))
        yield pd.DataFrame({"key": [str(k[0])], "ewma": [old]})

    picked = stream.select(F.col(key).cast("string").alias("key"), F.col(value).cast("long").alias("__value"), F.col(order).alias("__order"))
    return picked.groupBy("key").applyInPandasWithState(step, "key string, ewma long", "ewma long", "update", GroupStateTimeout.NoTimeout)


def rate_limit_stream(stream: DataFrame, key: str, tick: str, limit: int) -> DataFrame:
    """How many rows of each key and tick passed a limit and how many went beyond it; a tick's state expires."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((seen,))
        state.setTimeoutDuration(60_000)
        yield pd.DataFrame({"key": [str(k[0])], "tick": [int(k[1])], "passed": [min(seen, limit)], "over": [max(0, seen - limit)]})

    picked = stream.select(F.col(key).cast("string").alias("key"), F.col(tick).cast("long").alias("tick"))
    return picked.groupBy("key", "tick").applyInPandasWithState(step, "key string, tick long, passed long, over long", "seen long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def expiring_stream(stream: DataFrame, key: str, value: str, ttl_ms: int) -> DataFrame:
    """The last value of each key until its time to live runs out; a null clears it. Expiry gives a row with alive = false."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [str(k[0])], "value": [last], "alive": [False]})
            return
        last = None
        for f in frames:
            last = f["value"].iloc[-1]
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((str(last),))
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [str(k[0])], "value": [last], "alive": [last is not None]})

    picked = stream.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    return picked.groupBy("key").applyInPandasWithState(step, "key string, value string, alive boolean", "value string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def throttled(stream: DataFrame, sink, seconds: int = 1):
    """A started query that hands each batch to ``sink(df, id)`` at most once in so many seconds."""
    return stream.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(sink).start()


def tumbling_counts(stream: DataFrame, key: str, ts: str, length: str, late: str) -> DataFrame:
    """(key, start, n): rows of each key in windows that follow each other, with a watermark."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = timed.groupBy(F.window("__ts", length), F.col(key)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("window.start").alias("start"), "n")


def session_counts(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): rows of each key in sessions that a gap ends, with a watermark."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = timed.groupBy(F.session_window("__ts", gap), F.col(key)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def joined_within(left: DataFrame, right: DataFrame, key: str, ts: str, reach: str, late: str) -> DataFrame:
    """Pairs of rows of two streams with one key, where the right one comes up to ``reach`` before or after the left one.

    Watermarks on both sides let Spark drop rows that can have no partner any more. The columns of the left
    side stay; the right side's key and time go, and its other columns must have different names.
    """
    a = left.withColumn("__a", F.col(ts).cast("timestamp")).withWatermark("__a", late)
    b = right.withColumnsRenamed({key: "__k", ts: "__t"}).withColumn("__b", F.col("__t").cast("timestamp")).withWatermark("__b", late)
    near = (F.col(key) == F.col("__k")) & (F.col("__b") >= F.col("__a") - F.expr(f"INTERVAL {reach}")) & (F.col("__b") <= F.col("__a") + F.expr(f"INTERVAL {reach}"))
    return a.join(b, near).drop("__a", "__b", "__k", "__t")
