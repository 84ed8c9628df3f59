"""Registered queries of selections, joins and orders over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as S
from ..operators import behaviours as B
from ..operators import ranking as R
from ..operators import sets as H
from ..operators import spatial as P
from .registry import query

col, lit = F.col, F.lit


# Near things


@query("""SELECT DISTINCT c_custkey FROM customer, supplier WHERE (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal) < 2500.0 AND c_mktsegment NOT IN ('FURNITURE', 'MACHINERY') AND c_nationkey % 5 <> 0 AND (c_custkey + s_suppkey) % 3 <> 0""")
def detected_players(t, spark):
    """Those near a detector that may be seen at all, and are in its line of sight, which is tested last."""
    players = t("customer").where(~col("c_mktsegment").isin("FURNITURE", "MACHINERY") & (col("c_nationkey") % 5 != 0)).select("c_custkey", col("c_acctbal").alias("x"))
    pairs = P.pairs_within(players, t("supplier").select("s_suppkey", col("s_acctbal").alias("x")), ["x"], 50.0)
    return pairs.where((col("c_custkey") + col("s_suppkey")) % 3 != 0).select("c_custkey").distinct()


@query("""SELECT DISTINCT p_partkey FROM part, supplier WHERE p_type = 'PROMO' AND p_partkey BETWEEN s_suppkey * 9 - 6 AND s_suppkey * 9 + 6 AND p_size BETWEEN s_nationkey - 6 AND s_nationkey + 6""")
def inside_inflated_box(t, spark):
    """One type of thing inside the box of a reach around each centre."""
    boxes = t("supplier").select(*(x for a, c in (("x", col("s_suppkey") * 9), ("y", col("s_nationkey"))) for x in ((c - 6).cast("double").alias(f"min_{a}"), (c + 7).cast("double").alias(f"max_{a}"))))
    pts = t("part").where("p_type = 'PROMO'").select("p_partkey", col("p_partkey").cast("double").alias("x"), col("p_size").cast("double").alias("y"))
    return P.points_in_boxes(pts, boxes, "p_partkey", 8.0, "xy").select("p_partkey")


@query("""WITH d AS (SELECT s_suppkey, c_custkey, (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal) AS d2 FROM supplier, customer)
SELECT s_suppkey, 'near' AS class, count(*) AS n FROM d WHERE d2 < 400 GROUP BY 1 UNION ALL SELECT s_suppkey, 'middle', count(*) FROM d WHERE d2 < 10000 GROUP BY 1 UNION ALL SELECT s_suppkey, 'far', count(*) FROM d WHERE d2 < 62500 GROUP BY 1""")
def reach_classes(t, spark):
    """How many lie within each class of reach."""
    return P.by_reach_class(t("supplier").select("s_suppkey", col("s_acctbal").alias("x")), t("customer").select(col("c_acctbal").alias("x")), ["x"], {"near": 20.0, "middle": 100.0, "far": 250.0}, "s_suppkey")


@query("""SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal), c_custkey)::INT AS place
FROM supplier JOIN customer ON (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal) <= 90000.0 QUALIFY place <= 3""")
def some_in_radius(t, spark):
    """Up to three within a radius of each centre (a top-k report)."""
    a, b = t("supplier").select("s_suppkey", col("s_acctbal").alias("x")), t("customer").select("c_custkey", col("c_acctbal").alias("x"))
    return P.some_within(a, b, ["x"], 300.0, "s_suppkey", "c_custkey", 3).select("s_suppkey", "c_custkey", "place")


@query("""WITH l AS (SELECT p_partkey % 20 AS x, p_size % 10 AS y, p_partkey % 7 AS z, min(p_size) AS level FROM part GROUP BY ALL),
c AS (SELECT s_suppkey, s_suppkey % 20 AS x, s_nationkey % 10 AS y, s_suppkey % 7 AS z, 12 AS level FROM supplier),
b AS (SELECT s_suppkey, l.x, l.y, l.z, l.level FROM c JOIN l ON l.x BETWEEN c.x - 2 AND c.x + 2 AND l.y BETWEEN c.y - 2 AND c.y + 2 AND l.z BETWEEN c.z - 2 AND c.z + 2 AND l.level < c.level QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY l.level, l.x, l.z, l.y) = 1)
SELECT c.s_suppkey, coalesce(b.x, c.x)::BIGINT AS x, coalesce(b.y, c.y)::BIGINT AS y, coalesce(b.z, c.z)::BIGINT AS z, coalesce(b.level, c.level)::INT AS level FROM c LEFT JOIN b USING (s_suppkey)""")
def closest_section(t, spark):
    """The section with the least distance in the cube around each one, if it is less than its own."""
    k = col("p_partkey")
    levels = t("part").groupBy((k % 20).alias("x"), (col("p_size") % 10).cast("long").alias("y"), (k % 7).alias("z")).agg(F.min("p_size").alias("level"))
    s = col("s_suppkey")
    centres = t("supplier").select("s_suppkey", (s % 20).alias("x"), (col("s_nationkey") % 10).cast("long").alias("y"), (s % 7).alias("z"), lit(12).alias("level"))
    return P.nearest_cell(centres, levels, 2, "s_suppkey")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, bool_or(i) OVER (PARTITION BY l_orderkey) AS found, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n
FROM (SELECT l_orderkey, l_linenumber, 10 + 3 - l_quantity BETWEEN -20 AND 0 AND 3 - 10 + l_linenumber BETWEEN -6 AND -4 AS i FROM lineitem)) WHERE i OR (NOT found AND n = 1)""")
def structure_bounds(t, spark):
    """Points turned about a pivot that lie inside bounds; of a structure without any, its first one."""
    from ..operators.encoding import mirrored_rotated

    x, z = mirrored_rotated(col("l_linenumber"), col("l_quantity"), "", 90, (10, 3))
    return P.inside_or_first(t("lineitem"), "l_orderkey", "l_linenumber", x.between(-20, 0) & z.between(-6, -4)).select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size BETWEEN s_nationkey AND s_nationkey + s_suppkey % 4""")
def intervals_held(t, spark):
    """Points inside intervals, ends included, without comparing all pairs."""
    spans = t("supplier").select("s_suppkey", col("s_nationkey").alias("low"), (col("s_nationkey") + col("s_suppkey") % 4).alias("high"))
    return P.interval_join(t("part").select("p_partkey", "p_size"), spans, "p_size", "low", "high", 4.0).select("p_partkey", "s_suppkey")


@query("""SELECT hint, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey, (VALUES ('merge'), ('shuffle_hash'), ('broadcast')) h(hint) GROUP BY 1""")
def join_hints(t, spark):
    """One join by sort-merge, shuffled hash and, as the table of nations is small, broadcast."""
    out = [t("orders").join(t("customer").hint(h), col("c_custkey") == col("o_custkey")).agg(F.count("*").alias("n")).withColumn("hint", lit(h)) for h in ("merge", "shuffle_hash", "broadcast")]
    return out[0].unionByName(out[1]).unionByName(out[2])


# Types, flags and sets


@query("""SELECT event_id, x::INT AS x FROM (SELECT event_id, TRY_CAST(CASE WHEN event_type = 'click' THEN event_type ELSE user_id::VARCHAR END AS INT) AS x FROM events) WHERE x > 5""")
def typed_filter(t, spark):
    """Values that can be read as a number and pass a test; others are dropped."""
    df = t("events").select("event_id", F.when(col("event_type") == "click", col("event_type")).otherwise(col("user_id").cast("string")).alias("x"))
    return B.typed(df, "x", "int", lambda c: c > 5)


@query("""SELECT p_partkey::VARCHAR AS p_partkey, p_size::VARCHAR AS p_size, p_type FROM part""")
def all_cast(t, spark):
    """All columns as one type."""
    return B.cast_all(t("part").select("p_partkey", "p_size", "p_type"), "string")


@query("""SELECT c, least(count(*), CASE c WHEN 'monster' THEN 20 WHEN 'creature' THEN 5 ELSE 1000000 END) AS n FROM (SELECT CASE c_nationkey % 4 WHEN 0 THEN 'misc' WHEN 1 THEN 'monster' WHEN 2 THEN 'creature' ELSE 'ambient' END AS c FROM customer WHERE NOT c_acctbal < 0 AND c_mktsegment <> 'BUILDING') WHERE c <> 'misc' GROUP BY 1""")
def spawn_filter(t, spark):
    """Entities that count for spawning, up to the limit of their category."""
    kind = F.element_at(F.array(*map(lit, ("misc", "monster", "creature", "ambient"))), (col("c_nationkey") % 4 + 1).cast("int"))
    df = t("customer").withColumn("c", kind)
    return B.spawn_counts(df, "c", col("c_acctbal") < 0, col("c_mktsegment") != "BUILDING", {"monster": 20, "creature": 5})


@query("""SELECT p_partkey FROM part WHERE p_size % 4 <> 0 OR (p_size > 20 AND p_type <> 'LARGE')""")
def fluids_to_process(t, spark):
    """Fluids that need processing: those that are no source, and sources that can flow."""
    source, flows = col("p_size") % 4 == 0, (col("p_size") > 20) & (col("p_type") != "LARGE")
    return t("part").where(~source | flows).select("p_partkey")


@query("""SELECT event_id FROM events WHERE (event_type = 'click' AND user_id % 2 = 1) OR event_type IN ('view', 'purchase', 'error')""")
def velocity_filter(t, spark):
    """Packets of four kinds; of one kind only if the position changed."""
    return t("events").where(((col("event_type") == "click") & (col("user_id") % 2 == 1)) | col("event_type").isin("view", "purchase", "error")).select("event_id")


@query("""SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) FILTER (l_tax > 0.03) AS shown FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_tax > 0.03) > 0""")
def visible_effects(t, spark):
    """The options of the effects that can be seen, as a list for each holder that has some."""
    held = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", (col("l_tax") > 0.03).alias("visible")))).alias("e"))
    shown = F.transform(F.filter("e", lambda e: e["visible"]), lambda e: e["l_partkey"])
    return held.select("l_orderkey", shown.alias("shown")).where(F.size("shown") > 0)


@query("""SELECT DISTINCT l_suppkey AS receiver, l_partkey AS target FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')""")
def visible_players(t, spark):
    """Pairs of a receiver and a target that is not hidden from it."""
    pairs = t("lineitem").select(col("l_suppkey").alias("receiver"), col("l_partkey").alias("target"), "l_returnflag")
    return B.visible_pairs(pairs.select("receiver", "target").distinct(), pairs.where("l_returnflag = 'R'"), "receiver", "target")


@query("""SELECT 'none' AS wanted, 0 AS n UNION ALL SELECT 'some', count(*) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def empty_set(t, spark):
    """A search for members of a set; an empty set ends it before anything is read."""
    sets = {"none": t("nation").where("n_regionkey < 0"), "some": t("nation").where("n_regionkey = 1")}
    out = [H.retained(t("customer"), s.select(col("n_nationkey").alias("c_nationkey")), ["c_nationkey"]).agg(F.count("*").alias("n")).withColumn("wanted", lit(name)) for name, s in sets.items()]
    return out[0].unionByName(out[1])


@query("""SELECT n_nationkey, CASE WHEN n_regionkey <> 3 THEN n_name END AS button FROM nation WHERE n_regionkey IN (0, 1, 4)""")
def permitted_buttons(t, spark):
    """Entries that are permitted and have something to show."""
    made = t("nation").select("n_nationkey", F.when(col("n_regionkey") != 3, col("n_name")).alias("button"), col("n_regionkey").isin(0, 1, 3, 4).alias("allowed"))
    return made.where("allowed").where("button is not null").select("n_nationkey", "button")


@query("""SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size < 20 AND length(regexp_replace(p_name, '[aeiou]', '', 'g')) > 6""")
def costly_last(t, spark):
    """Type, then a flag, then the costly test."""
    return t("part").where((col("p_type") == "PROMO") & (col("p_size") < 20) & (F.length(F.regexp_replace("p_name", "[aeiou]", "")) > 6)).select("p_partkey")


@query("""SELECT a.c_custkey, min(b.c_custkey) AS other FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND b.c_custkey <> a.c_custkey AND b.c_acctbal > 0 GROUP BY 1""")
def first_other(t, spark):
    """For each one the first other of its kind that is alive: the least of its group, or the second for that one itself."""
    alive = t("customer").where("c_acctbal > 0").select("c_nationkey", "c_mktsegment", col("c_custkey").alias("o"))
    two = R.top_k_per_key(alive, ["c_nationkey", "c_mktsegment"], [], ["o"], 2).drop("place")
    found = t("customer").join(two, ["c_nationkey", "c_mktsegment"]).where("c_custkey <> o")
    return found.groupBy("c_custkey").agg(F.min("o").alias("other"))


@query("""WITH b AS (SELECT p_partkey AS behaviour, p_size % 5 AS priority, p_partkey % 6 AS activity FROM part WHERE p_type <> 'LARGE')
SELECT s_suppkey, (row_number() OVER (PARTITION BY s_suppkey ORDER BY priority, activity, behaviour) - 1)::INT AS place, priority, activity, behaviour FROM supplier JOIN b ON ((s_suppkey % 60) >> activity::INT) & 1 = 1""")
def behaviours_to_start(t, spark):
    """The behaviours of the active activities by priority, without those that run."""
    k = col("p_partkey")
    table = t("part").select((col("p_size") % 5).alias("priority"), (k % 6).cast("int").alias("activity"), k.alias("behaviour"), (col("p_type") == "LARGE").alias("running"))
    return B.active_behaviours(table, t("supplier").select("s_suppkey", (col("s_suppkey") % 60).alias("bits")), "s_suppkey")


@query("""SELECT p_type, turn FROM (SELECT p_type, arg_min(p_size, p_partkey) AS s FROM part GROUP BY 1), (SELECT unnest([0, 90, 180, 270]) AS turn) WHERE turn <= s * 9""")
def rotations_once(t, spark):
    """The turns to try for each element, where it is met first; later it is skipped."""
    turns = F.filter(F.array(*map(lit, (0, 90, 180, 270))), lambda x: x <= col("p_size") * 9)
    return B.first_of_each(t("part").select("p_type", "p_partkey", "p_size"), ["p_type"], ["p_partkey"], turns).select("p_type", col("repeat").alias("turn"))


@query("""SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier""")
def union_all(t, spark):
    """All rows of two tables."""
    return t("nation").select(col("n_nationkey").alias("k")).unionByName(t("supplier").select(col("s_nationkey").alias("k")))


# Orders


_COLOURS = [(i * 37 % 256, i * 91 % 256, i * 151 % 256) for i in range(16)]
_F = "::FLOAT"


@query(
    "WITH c AS (SELECT p_partkey, p_partkey * 7 % 256 AS a, p_partkey % 256 AS r, p_partkey * 3 % 256 AS g, p_size * 5 % 256 AS b FROM part), p(i, pr, pg, pb) AS (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(_COLOURS) if i >= 4) + """),
d AS (SELECT p_partkey, a, i, ((2.0::FLOAT + ((r + pr)::FLOAT / 2.0::FLOAT) / 256.0::FLOAT) * (r - pr)::FLOAT * (r - pr)::FLOAT + 4.0::FLOAT * (g - pg)::FLOAT * (g - pg)::FLOAT + (2.0::FLOAT + (255.0::FLOAT - (r + pr)::FLOAT / 2.0::FLOAT) / 256.0::FLOAT) * (b - pb)::FLOAT * (b - pb)::FLOAT)::FLOAT AS d FROM c, p)
SELECT p_partkey, CASE WHEN any_value(a) < 128 THEN 0 ELSE arg_min(i, (d, i)) END::INT AS nearest FROM d GROUP BY 1""")
def map_palette(t, spark):
    """Packed colours matched to a palette from index 4 on; the more transparent ones match index 0."""
    k = col("p_partkey").cast("int")
    packed = ((k * 7 % 256).cast("long") * 16777216 + (k % 256) * 65536 + (k * 3 % 256) * 256 + col("p_size") * 5 % 256).alias("argb")
    df = t("part").select("p_partkey", packed).withColumn("c", N.argb(col("argb")))
    as_struct = lambda c: dict(zip("rgb", (lit(x) for x in c), strict=True))
    return R.nearest_of(df, _COLOURS, lambda c: N.redmean(col("c"), as_struct(c)), start=4, unless=col("c.a") < 128).select("p_partkey", "nearest")


@query("""SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey FROM orders ORDER BY o_orderpriority, o_orderdate, o_custkey, o_orderkey LIMIT 1""")
def global_argmin(t, spark):
    """The first task of all queues; of queues that tie the first one has it (a top-1 report)."""
    return R.global_least(t("orders"), "o_custkey", ["o_orderpriority", "o_orderdate"], ["o_orderkey"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey % 2147483648 * 2654435761 + 11 * 40503) % 4294967296, l_partkey, l_linenumber) = 1""")
def shuffled_first(t, spark):
    """For each key the first row in shuffled order that passes a test."""
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").where("l_quantity > 10")
    return R.top_k_per_key(df, ["l_orderkey"], [R.shuffle_key(col("l_partkey"), 11)], ["l_partkey", "l_linenumber"], 1).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END AS at FROM customer""")
def field_order(t, spark):
    """Rows in the order of a list of names, with their place in it; unknown ones come last."""
    names = ["MACHINERY", "AUTOMOBILE"]
    at = F.array_position(F.array(*map(lit, names)), col("c_mktsegment"))
    return R.ordered_by_list(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", names).withColumn("at", F.when(at > 0, at).otherwise(3).cast("int"))


@query("""SELECT l_orderkey, list(l_extendedprice ORDER BY l_extendedprice) AS prices FROM lineitem GROUP BY 1""")
def list_sort(t, spark):
    """A sorted list for each key."""
    return t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("prices"))


@query("""SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'a' WHEN 'LARGE' THEN 'b' END AS token, {'PROMO': 1, 'LARGE': 2}[p_type] AS by_map FROM part""".replace("{'PROMO': 1, 'LARGE': 2}[p_type]", "CASE p_type WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 2 END"))
def map_views(t, spark):
    """Values looked up in maps by key; unknown keys give null."""
    names, numbers = (F.create_map(*(lit(x) for kv in m.items() for x in kv)) for m in ({"PROMO": "a", "LARGE": "b"}, {"PROMO": 1, "LARGE": 2}))
    return t("part").select("p_partkey", F.try_element_at(names, col("p_type")).alias("token"), F.try_element_at(numbers, col("p_type")).alias("by_map"))


@query("""SELECT l_orderkey, l_linenumber, upper(p_type) || '/' || p_size AS made FROM lineitem JOIN part ON p_partkey = l_partkey""")
def memo_map(t, spark):
    """A costly value made once for each key and joined."""
    made = t("part").select(col("p_partkey").alias("l_partkey"), F.concat(F.upper("p_type"), lit("/"), col("p_size").cast("string")).alias("made"))
    return t("lineitem").join(made, "l_partkey").select("l_orderkey", "l_linenumber", "made")


@query("""SELECT c_custkey, n_name AS plugin FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) n ON n_nationkey = c_nationkey""")
def class_source(t, spark):
    """A loader's plugin, or null if it is unknown."""
    known = t("nation").where("n_regionkey <> 0").select(col("n_nationkey").alias("c_nationkey"), col("n_name").alias("plugin"))
    return t("customer").join(known, "c_nationkey", "left").select("c_custkey", "plugin")


@query("""SELECT event_id, value * 2 AS value FROM events WHERE event_type <> 'error' AND NOT value * 2 > 300""")
def event_hooks(t, spark):
    """Events that a hook has changed and none has cancelled."""
    return B.Hooks().change("value", col("value") * 2).veto(col("event_type") == "error").veto(col("value") > 300).run(t("events").select("event_id", "event_type", "value")).select("event_id", "value")


@query("""SELECT count(*) AS n, max(user_id) AS top FROM events WHERE event_type <> 'error'""")
def event_observers(t, spark):
    """What observers saw of the events that took place."""
    return B.Hooks().veto(col("event_type") == "error").observe("n", F.count("*")).observe("top", F.max("user_id")).observed(t("events"))


@query("""SELECT p_partkey, 'p_size' AS field, 'between' AS rule, p_size::VARCHAR AS value FROM part WHERE NOT p_size BETWEEN 5 AND 40 UNION ALL SELECT p_partkey, 'p_name', 'one_word', p_name FROM part WHERE contains(p_name, ' ')
UNION ALL SELECT p_partkey, 'p_type', 'own', p_type FROM part WHERE p_type = 'LARGE'""")
def custom_rules(t, spark):
    """Rules put together one after the other, one of them the user's own."""
    rules = B.Rules().between("p_size", 5, 40).one_word("p_name").check("p_type", "own", lambda c: c != "LARGE")
    return rules.broken(t("part"), "p_partkey")
