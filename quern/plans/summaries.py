"""Registered queries of summaries, series and extensions over driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as S
from ..operators import counts as C
from ..operators import regions as A
from ..operators import series as T
from .registry import query

col, lit = F.col, F.lit


@query("""SELECT event_type, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def duration_percentiles(t, spark):
    """Least, greatest, mean, median and 95th percentile of durations."""
    out = C.duration_summary(t("events"), ["event_type"], "value", {"p95": 0.95})
    return out.select("event_type", "least", "greatest", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95")))


@query("""SELECT event_type, round(avg(floor(value)::BIGINT * 1000) / 1000000.0, 9) AS ms FROM events GROUP BY 1""")
def mean_tick_ms(t, spark):
    """Mean tick time, measured in nanoseconds and told in milliseconds."""
    return t("events").groupBy("event_type").agg(F.round(F.avg(F.floor("value").cast("long") * 1000) / 1e6, 9).alias("ms"))


@query("""WITH c AS (SELECT p_partkey AS k, p_partkey % 23 AS x, p_partkey // 23 AS z, p_size % 9 AS level, p_size % 9 = 8 AS source FROM part)
SELECT c.k, count(n.k) FILTER (n.source) AS sources, CASE WHEN count(n.k) FILTER (n.source) < 2 THEN greatest(coalesce(max(n.level), 0) - 2, 0) END::INT AS flows FROM c LEFT JOIN c n ON abs(c.x - n.x) + abs(c.z - n.z) = 1 GROUP BY 1""")
def fluid_levels(t, spark):
    """The level that flows into each cell from its four neighbours, and how many of them are sources."""
    k, level = col("p_partkey"), col("p_size") % 9
    cells = t("part").select(k.alias("k"), (k % 23).alias("x"), F.floor(k / 23).alias("z"), level.alias("level"), (level == 8).alias("source"))
    return C.neighbour_levels(cells, "k", "x", "z", "level", "source", 2)


@query("""SELECT l_orderkey, round(sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 0.8 WHEN 'N' THEN 0.4 ELSE 0 END), 6) AS total FROM lineitem GROUP BY 1""")
def weighted_contributions(t, spark):
    """Contributions with the weight of their kind; some kinds count for nothing."""
    out = C.weighted_kinds(t("lineitem"), "l_orderkey", "l_returnflag", col("l_quantity"), {"A": 0.8, "N": 0.4})
    return out.select("l_orderkey", F.round("total", 6).alias("total"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, (grouping(o_orderstatus) * 2 + grouping(o_orderpriority))::INT AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""")
def tier_b_grouping_sets(t, spark):
    """Counts by several sets of keys in one pass."""
    sets = [[col("o_orderstatus")], [col("o_orderpriority")], [col("o_orderstatus"), col("o_orderpriority")]]
    return t("orders").groupingSets(sets, col("o_orderstatus"), col("o_orderpriority")).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("g"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def tier_b_pivot(t, spark):
    """Counts by priority, a column for each state."""
    out = t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return out.select("o_orderpriority", *(F.coalesce(c, lit(0)).alias(c.lower()) for c in "FOP"))


@query("""SELECT 'distinct' AS sketch, true AS close UNION ALL SELECT 'median', true""")
def tier_b_sketches(t, spark):
    """Sketches of distinct values and of the median, made by part and merged, against the exact values: within five percent."""
    parts = t("orders").groupBy("o_orderpriority").agg(F.hll_sketch_agg("o_custkey").alias("s"))
    both = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("about")).unionByName(t("orders").agg(F.count_distinct("o_custkey").alias("exact")), allowMissingColumns=True)
    distinct = both.agg(F.max("about").alias("about"), F.max("exact").alias("exact"))
    median = t("orders").agg(F.percentile_approx("o_totalprice", 0.5, 10000).alias("about"), F.percentile("o_totalprice", 0.5).alias("exact"))
    close = (F.abs(col("about") - col("exact")) <= 0.05 * col("exact")).alias("close")
    return distinct.select(lit("distinct").alias("sketch"), close).unionByName(median.select(lit("median").alias("sketch"), close))


@query("""SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_totalprice) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS next, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def tier_b_frames(t, spark):
    """First values and frames of rows."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.first("o_orderkey").over(w).alias("first"), F.last("o_totalprice").over(w.rowsBetween(-1, 1)).alias("next"), F.count("*").over(w.rowsBetween(-2, 0)).alias("n"), F.round(F.percent_rank().over(w), 9).alias("p"), F.round(F.cume_dist().over(w), 9).alias("c"))


@query("""SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY ALL""")
def tier_b_tumbling(t, spark):
    """Counts in windows that follow each other."""
    e = t("events").withColumn("at", col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("at", "6 hours")).agg(F.count("*").alias("n")).select("event_type", col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def tier_b_sessions(t, spark):
    """Counts in sessions that a gap of six hours ends."""
    e = t("events").withColumn("at", col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("n")).select("user_id", col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


# Series


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW), 9) AS mean FROM events""")
def frame_alias(t, spark):
    """The report called "10 s" reads the frame of 15 s (stretched)."""
    out = T.trailing_means(t("events"), "event_type", "ts", "value", {"f": T.frame_of("10s")}, scale=240)
    return out.select("event_id", F.round("mean_f", 9).alias("mean"))


@query("""SELECT event_type, 'TPS ' || format('{:,.2f}', round(avg(value) * 1000, 2)) || ' / ' || format('{:,}', count(*)) || ' of <what>' AS bar FROM events GROUP BY 1""")
def bar_text(t, spark):
    """A bar's text from a report: numbers in their formats, unknown placeholders as they are."""
    out = t("events").groupBy("event_type").agg(F.round(F.avg("value") * 1000, 2).alias("tps"), F.count("*").alias("players"))
    return out.select("event_type", S.render(lit("TPS <tps> / <players> of <what>"), {"tps": N.shown(col("tps"), 2), "players": N.shown(col("players"), 0)}).alias("bar"))


@query("""WITH g AS (SELECT user_id, ts, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id, min(epoch_us(ts)) + 36000000000 AS at FROM g WHERE gap >= 36000000000 GROUP BY 1""")
def keepalive(t, spark):
    """When users who stay silent for ten hours are dropped."""
    return T.keepalive_timeouts(t("events"), "user_id", "ts", "event_id", 36_000_000)


@query("""SELECT event_id FROM (SELECT event_id, event_type = lag(event_type) OVER w AS same, event_id % 7 < 5 AS early FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE NOT (coalesce(same, false) AND early)""")
def idle_skip(t, spark):
    """Ticks at which a sleeper's state has changed or its time has come."""
    return T.awake(t("events"), "user_id", ["ts", "event_id"], "event_type", lit(5), col("event_id") % 7).select("event_id")


@query("""WITH RECURSIVE s AS (SELECT user_id, 20 + event_id * 31 % 60 AS draw, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, draw AS rest, 0 AS hits FROM s WHERE i = 1 UNION ALL
SELECT r.user_id, s.i, CASE WHEN rest - 9 <= 0 THEN s.draw ELSE rest - 9 END, hits + CASE WHEN rest - 9 <= 0 THEN 1 ELSE 0 END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT user_id, max(hits)::INT AS hits FROM r GROUP BY 1""")
def countdown(t, spark):
    """How often a countdown runs out that starts anew from a draw each time."""
    seq = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("s"))
    return seq.select("user_id", T.countdown_hits(col("s"), 9, F.transform("s", lambda e: 20 + e * 31 % 60)).alias("hits"))


@query("""WITH c AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'pause' ELSE 'run' END AS command FROM events WHERE event_type IN ('error', 'purchase'))
SELECT e.event_id FROM events e WHERE coalesce((SELECT arg_max(command, c.ts) FROM c WHERE c.user_id = e.user_id AND c.ts <= e.ts), 'run') <> 'pause'""")
def paused_feed(t, spark):
    """Rows of a feed while it runs; commands pause it and let it go on."""
    e = t("events")
    commands = e.where(col("event_type").isin("error", "purchase")).select("user_id", "ts", F.when(col("event_type") == "error", "pause").otherwise("run").alias("command"))
    return T.controlled(e.select("user_id", "ts", "event_id"), commands, "user_id", "ts").select("event_id")


@query("""SELECT (epoch_us(ts) // 86400000000)::BIGINT AS period, min(ts) AS at FROM events GROUP BY 1""")
def autosave(t, spark):
    """The first moment of each day."""
    return T.autosaves(t("events"), "ts", 86_400)


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'view' AND user_id > 3""")
def thread_feed(t, spark):
    """The ends of ticks of the threads that are watched."""
    return t("events").where((col("event_type") == "view") & (col("user_id") > 3)).select("event_id", "user_id")


# Extensions


@query("""SELECT c_nationkey, round(median(c_acctbal), 6) AS middle FROM customer GROUP BY 1""")
def region_apply(t, spark):
    """A function of the user's own over each region."""
    return A.apply_per_region(t("customer").select("c_nationkey", "c_acctbal"), "c_nationkey", lambda f: pd.DataFrame({"c_nationkey": f["c_nationkey"].iloc[:1], "middle": [round(f["c_acctbal"].median(), 6)]}), "c_nationkey int, middle double")


@query("""SELECT p_partkey, x::INT AS x FROM part, LATERAL (SELECT unnest(range(p_size % 4)) AS x)""")
def tier_b_table_function(t, spark):
    """A table function of the user's own, called for each row."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="x int")
    class Upto:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("upto_rows", Upto)
    t("part").select("p_partkey", (col("p_size") % 4).alias("n")).createOrReplaceTempView("parts_for_rows")
    return spark.sql("SELECT p_partkey, x FROM parts_for_rows, LATERAL upto_rows(n)")


@query("""SELECT p_partkey, p_size * 2 + 1 AS doubled FROM part""")
def tier_b_sql_function(t, spark):
    """A function of the user's own in SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION doubled_and_one(n INT) RETURNS INT RETURN n * 2 + 1")
    t("part").createOrReplaceTempView("parts_for_functions")
    return spark.sql("SELECT p_partkey, doubled_and_one(p_size) AS doubled FROM parts_for_functions")
