"""Series of ticks: trailing frames, means of means, moving averages, limits by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Trailing frames in seconds. The report called "10 s" reads the frame of 15 s.
FRAMES = {"5s": 5, "15s": 15, "1m": 60, "5m": 300, "15m": 900}
ALIASES = {"10s": "15s"}
#: Ticks per second where nothing was measured.
DEFAULT_RATE = 20.0


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def trailing_means(df: DataFrame, handle: str, ts: str, value: str, frames: dict[str, int] | None = None, scale: int = 1) -> DataFrame:
    """Mean of ``value`` over each trailing frame [t - w, t] of its handle, one column ``mean_<frame>`` each.

    One shuffle and one sort serve all frames. ``scale`` stretches the frames for sparse series.
    """
    frames = frames or FRAMES
    by_time = W.partitionBy(handle).orderBy(F.col("__us"))
    out = df.withColumn("__us", micros(F.col(ts)))
    for name, seconds in frames.items():
        out = out.withColumn(f"mean_{name}", F.avg(value).over(by_time.rangeBetween(-seconds * scale * 1_000_000, 0)))
    return out.drop("__us")


def frame_report(df: DataFrame, handle: str, ts: str, value: str, now: Column, frames: dict[str, int] | None = None, scale: int = 1) -> DataFrame:
    """For each handle the array of means over all frames that end at ``now``; a frame without samples is null."""
    frames = frames or FRAMES
    age = micros(now) - micros(F.col(ts))
    means = [F.avg(F.when((age >= 0) & (age <= s * scale * 1_000_000), F.col(value))) for s in frames.values()]
    return df.groupBy(handle).agg(F.array(*means).alias("means"))


def mean_of_means(df: DataFrame, handle: str, value: str, default: float = DEFAULT_RATE) -> DataFrame:
    """Every handle's mean counts once, whatever its number of samples; nothing at all gives the default."""
    each = df.groupBy(handle).agg(F.coalesce(F.avg(value), F.lit(default)).alias("m"))
    return each.agg(F.coalesce(F.avg("m"), F.lit(default)).alias("mean"), F.count("*").alias("handles"))


def utilisation(df: DataFrame, handle: str, busy_ns: str, window_ns: int) -> DataFrame:
    """Busy share of a window, 0 to 1."""
    return df.groupBy(handle).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(busy_ns) / window_ns)).alias("utilisation"))


def integer_ewma(values: Column, start: int = 0) -> Column:
    """(3 x old + new) / 4 in whole numbers, rounded towards zero, over an array in order of time.

    Rounding makes the result depend on every step, so a key's values cannot be split: they are one array in one task.
    """
    return F.aggregate(values, F.lit(start).cast("long"), lambda old, x: F.call_function("div", old * 3 + x, F.lit(4).cast("long")))


def rate_limited(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The rows with their number inside each key (``seq``), whether they pass (``passed``), and how far beyond the limit they are (``over``)."""
    seq = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("seq", seq).withColumn("passed", F.col("seq") <= limit).withColumn("over", F.greatest(F.col("seq") - limit, F.lit(0)))


def in_slot(key: Column, tick: Column, slots: int) -> Column:
    """Whether a key's turn has come: slots are taken in turn, one a tick."""
    return F.pmod(key, F.lit(slots)) == F.pmod(tick, F.lit(slots))


def every_nth(tick: Column, n: int) -> Column:
    return tick % n == 0


def live_until(df: DataFrame, keys: list[str], ts: str, value: str, ttl_seconds: int, now: Column) -> DataFrame:
    """The last value of each key if its time to live has not run out; a null value clears the key and its time."""
    last = df.groupBy(*keys).agg(F.max(F.struct(F.col(ts).alias("at"), F.col(value).alias("v"))).alias("s"))
    alive = F.col("s.v").isNotNull() & (micros(now) - micros(F.col("s.at")) < ttl_seconds * 1_000_000)
    return last.where(alive).select(*keys, F.col("s.v").alias(value))


def frame_of(name: str) -> int:
    """Seconds of a frame by its name; the one called "10 s" is that of 15 s."""
    return FRAMES[ALIASES.get(name, name)]


def keepalive_timeouts(df: DataFrame, key: str, ts: str, tie: str, limit_ms: int) -> DataFrame:
    """(key, at): when each key that stays silent for too long is dropped. One message a second waits for an answer, and any answer
    clears all that wait; the first gap between answers in which as many seconds pass as the limit has ends the key."""
    us = micros(F.col(ts))
    gap = F.lead(us).over(W.partitionBy(key).orderBy(us, tie)) - us
    late = df.withColumn("__us", us).withColumn("__gap", gap).where(F.col("__gap") >= limit_ms * 1000)
    return late.groupBy(key).agg(F.min(F.col("__us") + limit_ms * 1000).alias("at"))


def awake(df: DataFrame, key: str, order: list[str], state: str, wake_at: Column, tick: Column) -> DataFrame:
    """The ticks at which something happens: its state is another one than the tick before, or the time to wake has come."""
    same = F.coalesce(F.col(state).eqNullSafe(F.lag(state).over(W.partitionBy(key).orderBy(*order))), F.lit(False))
    first = F.row_number().over(W.partitionBy(key).orderBy(*order)) == 1
    return df.withColumn("__idle", same & ~first & (tick < wake_at)).where(~F.col("__idle")).drop("__idle")


def countdown_hits(steps: Column, speed: int, reset: Column) -> Column:
    """How often a countdown over an array of steps runs out: each step takes ``speed`` off, and at 0 or below it fires and starts
    again from the step's draw in the array ``reset``. It starts from the first draw."""
    start = F.struct(F.get(reset, F.lit(0)).cast("long").alias("left"), F.lit(0).alias("hits"))

    def step(acc: Column, i: Column) -> Column:
        left = acc["left"] - speed
        fires = left <= 0
        return F.struct(F.when(fires, F.get(reset, i)).otherwise(left).cast("long").alias("left"), (acc["hits"] + fires.cast("int")).alias("hits"))

    return F.aggregate(F.sequence(F.lit(0), F.size(steps) - 1), start, step, lambda acc: acc["hits"])


def controlled(df: DataFrame, commands: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows of a feed that is not paused: the last command of the key at or before a row is none, ``run`` or ``sprint``.

    ``commands`` has the key, the time and ``command``; of a row and a command at one moment the command comes first.
    """
    rows = df.withColumn("__c", F.lit(None).cast("string")).withColumn("__o", F.lit(1))
    told = commands.select(key, ts, F.col("command").alias("__c")).withColumn("__o", F.lit(0))
    w = W.partitionBy(key).orderBy(ts, "__o").rowsBetween(W.unboundedPreceding, 0)
    state = rows.unionByName(told, allowMissingColumns=True).withColumn("__state", F.last("__c", ignorenulls=True).over(w))
    return state.where((F.col("__o") == 1) & F.coalesce(F.col("__state").isin("run", "sprint"), F.lit(True))).drop("__c", "__o", "__state")


def autosaves(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """(period, at): the first moment of each period in which a save is due."""
    period = F.floor(micros(F.col(ts)) / (seconds * 1_000_000))
    return df.groupBy(period.alias("period")).agg(F.min(ts).alias("at"))
