"""Registered queries of scans, sources and sinks over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as S
from ..operators import trees as D
from ..operators import worlds as O
from ..sources import config as C
from ..sources import tags as G
from ..sources.scratch import scratch_dir
from .registry import query

col, lit = F.col, F.lit


# Worlds


@query("""SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN c_mktsegment || ' [region=unknown]' ELSE c_mktsegment || ' region at ' || (n_nationkey * 16) || ', ' || (n_regionkey * 16) END AS label
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON n_nationkey = c_nationkey""")
def chunk_scan(t, spark):
    """Cells of each world with the name of their region, some without one."""
    regions = t("nation").where("n_regionkey <> 2").select(col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    df = t("customer").join(regions, "c_nationkey", "left")
    number = F.when(col("n_regionkey").isNotNull(), col("c_nationkey"))
    return df.select("c_custkey", O.region_label(col("c_mktsegment"), number, col("c_nationkey") * 16, col("n_regionkey") * 16).alias("label"))


@query("""SELECT 'region' AS scope, count(*) FILTER (c_acctbal > 0) AS players, count(*) AS entities, count(DISTINCT c_mktsegment) AS chunks, coalesce(sum(c_custkey % 5), 0)::BIGINT AS tile_entities FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'global', 0, 0, 0, 0""")
def region_counts(t, spark):
    """Counts of one region, tile entities among them; the global tick owns nothing."""
    counts = {"players": F.count_if(col("c_acctbal") > 0), "entities": F.count("*"), "chunks": F.count_distinct("c_mktsegment"), "tile_entities": F.sum(col("c_custkey") % 5)}
    rows = [O.one_region_counts(t("customer"), "c_nationkey", n, counts).withColumn("scope", lit(scope)) for scope, n in (("region", 3), ("global", None))]
    return rows[0].unionByName(rows[1])


@query("""SELECT c_mktsegment AS world, c_custkey AS chunk FROM customer WHERE c_nationkey = 3""")
def region_chunks(t, spark):
    """Cells of one region, under the name of their world and not of the region."""
    return t("customer").where("c_nationkey = 3").select(col("c_mktsegment").alias("world"), col("c_custkey").alias("chunk"))


@query("""WITH e AS (SELECT c_mktsegment AS rule, c_nationkey AS world, count(*) AS n FROM customer GROUP BY ALL)
SELECT e.rule, e.world, e.n, d.n AS standard FROM e LEFT JOIN (SELECT rule, n FROM e WHERE world = (SELECT min(world) FROM e)) d ON d.rule = e.rule""")
def game_rules(t, spark):
    """Each rule's value by world, with the value of the first world as its default."""
    each = t("customer").groupBy(col("c_mktsegment").alias("rule"), col("c_nationkey").alias("world")).agg(F.count("*").alias("n"))
    return O.rules_by_world(each, "rule", "world", "n").select("rule", F.explode("by_world").alias("world", "n"), col("default").alias("standard"))


@query("""SELECT p_partkey, p_name AS name, replace(lower('FROM_' || p_type), '_', '') AS source FROM part""")
def data_packs(t, spark):
    """Packs with the names of their sources made plain."""
    return t("part").select("p_partkey", col("p_name").alias("name"), O.pack_source(F.concat(lit("FROM_"), "p_type")).alias("source"))


@query("""SELECT c_name AS name, floor(c_acctbal)::BIGINT AS ping FROM customer WHERE c_acctbal >= 0""")
def ping_scan(t, spark):
    """Names and latencies of those connected."""
    return t("customer").where("c_acctbal >= 0").select(col("c_name").alias("name"), F.floor("c_acctbal").alias("ping"))


@query("""SELECT n_name AS name, n_regionkey::VARCHAR || '.0' AS version, string_agg(s_name, ', ' ORDER BY s_name) AS authors FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def plugin_scan(t, spark):
    """Names, versions and joined authors."""
    df = t("supplier").join(t("nation"), col("s_nationkey") == col("n_nationkey"))
    out = df.groupBy(col("n_name").alias("name"), F.concat(col("n_regionkey").cast("string"), lit(".0")).alias("version")).agg(F.array_sort(F.collect_list("s_name")).alias("a"))
    return out.select("name", "version", S.listed(col("a")).alias("authors"))


def _layers(t):
    return O.dense_layers(t("orders").select("o_custkey", (col("o_orderkey") % 12).cast("int").alias("y"), "o_orderkey"), ["o_custkey"], "y", "o_orderkey", 8)


@query("""SELECT o_custkey, y AS index, min(o_orderkey) AS value FROM (SELECT o_custkey, (o_orderkey % 12)::INT AS y, o_orderkey FROM orders) WHERE y < 8 GROUP BY ALL""")
def dense_scan(t, spark):
    """All filled places of dense layers."""
    return O.layer_scan(_layers(t), ["o_custkey"])


@query("""WITH d AS (SELECT o_custkey, o_orderkey % 12 AS y, min(o_orderkey) AS value FROM orders GROUP BY ALL)
SELECT c_custkey AS o_custkey, c_custkey % 13 - 2 AS y, value FROM customer LEFT JOIN d ON d.o_custkey = c_custkey AND d.y = c_custkey % 13 - 2 AND d.y < 8""")
def point_lookup(t, spark):
    """Places looked up by key and index, some below or beyond the layers."""
    wanted = t("customer").select(col("c_custkey").alias("o_custkey"), (col("c_custkey") % 13 - 2).alias("y"))
    return O.layer_lookup(_layers(t), wanted, ["o_custkey"], "y")


@query("""SELECT o_custkey, count(*)::INT AS n, max(y)::INT AS top FROM (SELECT DISTINCT o_custkey, o_orderkey % 12 AS y FROM orders) WHERE y < 8 GROUP BY 1""")
def block_map(t, spark):
    """Dense layers as a map of the filled places."""
    out = O.layer_map(_layers(t), ["o_custkey"]).where(F.size("cells") > 0)
    return out.select("o_custkey", F.size("cells").alias("n"), F.array_max(F.map_keys("cells")).alias("top"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem""")
def entity_arrays(t, spark):
    """Arrays of each cell taken apart."""
    held = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("e"))
    return held.select("l_orderkey", F.explode("e").alias("l_linenumber"))


# Configuration files


def _tree(t, table, value):
    """A tree of two levels: brands, and their parts."""
    p = t(table)
    top = p.select(F.replace("p_brand", lit("#"), lit("")).alias("path")).distinct().select("path", lit(True).alias("is_mapping"), lit(None).cast("string").alias("value"))
    return top.unionByName(p.select(F.concat(F.replace("p_brand", lit("#"), lit("")), lit(".p"), col("p_partkey").cast("string")).alias("path"), lit(False).alias("is_mapping"), value.alias("value")))


_TREE = "SELECT replace(p_brand, '#', '') AS path, true AS is_mapping, NULL::VARCHAR AS value FROM part GROUP BY 1 UNION ALL SELECT replace(p_brand, '#', '') || '.p' || p_partkey, false, {} FROM part"


@query(_TREE.format("p_type"))
def yaml_source(t, spark):
    """A tree written as YAML with a header and read again."""
    path = scratch_dir(spark)
    C.write_yaml(_tree(t, "part", col("p_type")), path, header="made by a query")
    return C.read_yaml(spark, path).drop("source")


@query(_TREE.format("CASE WHEN p_size > 25 THEN p_type ELSE p_name END"))
def yaml_reconciled(t, spark):
    """A file brought into the shape of a schema: missing paths are added with their defaults, unknown ones go, values stay."""
    path = scratch_dir(spark)
    schema = _tree(t, "part", col("p_name"))
    file = _tree(t, "part", col("p_type")).join(t("part").where("p_size <= 25").select(F.concat(F.replace("p_brand", lit("#"), lit("")), lit(".p"), col("p_partkey").cast("string")).alias("path")), "path", "left_anti")
    unknown = spark.createDataFrame([("Odd", True, None), ("Odd.x", False, "1")], "path string, is_mapping boolean, value string")
    C.write_yaml(file.unionByName(unknown), path)
    return C.load_reconciled(spark, path, schema).drop("source")


@query(_TREE.format("CASE WHEN p_size > 25 THEN 'new' ELSE p_type END"))
def yaml_saved_in_place(t, spark):
    """Values in memory laid over a file, which is written again; paths that the file lacks are not added."""
    path = scratch_dir(spark)
    C.write_yaml(_tree(t, "part", col("p_type")), path)
    memory = _tree(t, "part", lit("new")).join(t("part").where("p_size > 25").select(F.concat(F.replace("p_brand", lit("#"), lit("")), lit(".p"), col("p_partkey").cast("string")).alias("path")), "path", "left_semi")
    C.save_in_place(spark, path, memory.unionByName(spark.createDataFrame([("Odd", False, "1")], memory.schema)))
    return C.read_yaml(spark, path).drop("source")


@query("""SELECT n_nationkey::VARCHAR AS key, n_name AS value FROM nation UNION ALL SELECT 'r.k' || r_regionkey, r_name FROM region""")
def config_json(t, spark):
    """Properties and YAML files scanned into one JSON object each, hidden paths left out, and taken apart again."""
    props, yaml = scratch_dir(spark), scratch_dir(spark)
    t("nation").select(F.concat(col("n_nationkey").cast("string"), lit("="), "n_name")).write.text(props)
    r = t("region").select(F.concat(lit("r.k"), col("r_regionkey").cast("string")).alias("path"), lit(False).alias("is_mapping"), col("r_name").alias("value"))
    more = spark.createDataFrame([("r", True, None), ("secret", True, None), ("secret.key", False, "x")], r.schema)
    C.write_yaml(r.unionByName(more), yaml)
    both = C.read_properties(spark, props).unionByName(D.without_hidden(C.read_yaml(spark, yaml), ["secret"]))
    parsed = C.as_json(both).select(F.from_json("json", "map<string,string>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "value"))


@query("""SELECT r_name AS value FROM region""")
def default_fill(t, spark):
    """A target that is there stays as it is; only a missing one is filled."""
    path = scratch_dir(spark)
    tree = t("region").select(F.concat(lit("k"), col("r_regionkey").cast("string")).alias("path"), lit(False).alias("is_mapping"), col("r_name").alias("value"))
    C.write_yaml(tree, path, if_missing=True)
    C.write_yaml(tree.withColumn("value", lit("other")), path, if_missing=True)
    return C.read_yaml(spark, path).select("value")


@query("""SELECT 'part.' || k AS path, v AS value FROM (SELECT 'id' AS k, count(*)::VARCHAR AS v FROM part UNION ALL SELECT 'top', max(p_size)::VARCHAR FROM part)
UNION ALL SELECT 'DataVersion', '7'""")
def tag_files(t, spark):
    """A tag file in an old shape, moved into the new one and read; one in the new shape stays."""
    path = scratch_dir(spark)
    row = t("part").agg(F.count("*").alias("id"), F.max("p_size").alias("top")).first()
    old = {"DataVersion": (G.INT, 7), "id": (G.LONG, row["id"]), "top": (G.INT, row["top"])}
    G.write_tags(spark, [("root", G.gathered(G.gathered(old, "part"), "part"))], path)
    return G.read_tags(spark, path).select("path", "value")


@query("""SELECT s_suppkey::INT AS processor, 'model name' AS key, s_name AS value FROM supplier UNION ALL SELECT s_suppkey::INT, 'processor', s_suppkey::VARCHAR FROM supplier UNION ALL SELECT -1, 'processor', 'unknown'""")
def cpu_table(t, spark):
    """Blocks of a text file as a table of processors; a missing file gives one unknown processor."""
    path = scratch_dir(spark)
    blocks = t("supplier").orderBy("s_suppkey").select(F.concat(lit("processor\t: "), col("s_suppkey").cast("string"), lit("\nmodel name\t: "), "s_name", lit("\n")))
    blocks.coalesce(1).write.text(path)
    return C.cpu_topology(spark, path + "/part-*").unionByName(C.cpu_topology(spark, path + "/missing"))


@query("""SELECT count(*) AS removed FROM region""")
def removed_files(t, spark):
    """How many files directly in a folder a clean-up would remove."""
    path = scratch_dir(spark)
    n = t("region").count()
    spark.range(0, n, 1, n).select(col("id").cast("string")).write.text(path)
    spark.range(3).select(col("id").cast("string")).write.text(path + "/below")
    return C.old_files(spark, path, "part-*").agg(F.count("*").alias("removed"))


# Codecs and other formats


@query("""SELECT event_id, coalesce((props::JSON ->> 'k')::INT, 0) AS k, 20 AS rate, false AS frozen FROM events""")
def level_codec(t, spark):
    """A record read from JSON, with defaults for the fields that it lacks."""
    return t("events").select("event_id", C.decoded(col("props"), {"k": ("int", 0), "rate": ("int", 20), "frozen": ("boolean", False)}).alias("r")).select("event_id", "r.*")


@query("""SELECT p_partkey, CASE WHEN p_size > 30 THEN NULL ELSE p_size END AS view, coalesce(CASE WHEN p_size > 30 THEN NULL ELSE p_size END, -1) AS read_view, -1 AS read_send FROM part""")
def record_codec(t, spark):
    """A record of optional fields written as JSON without the absent ones and read with defaults."""
    df = t("part").select("p_partkey", F.when(col("p_size") <= 30, col("p_size")).alias("view"))
    raw = F.to_json(F.struct(col("view"), lit(None).cast("int").alias("send")))
    return df.withColumn("r", C.decoded(raw, {"view": ("int", -1), "send": ("int", -1)})).select("p_partkey", "view", col("r.view").alias("read_view"), col("r.send").alias("read_send"))


@query("""SELECT p_partkey, p_size FROM part""")
def profile_sink(t, spark):
    """A result written to a target that cannot be reached, and so to the next one."""
    used = C.write_first(t("part").select("p_partkey", "p_size"), ["nosuchstore://host/path", scratch_dir(spark)])
    return spark.read.parquet(used)


@query("""SELECT o_orderstatus AS version, max(o_orderkey) AS latest, max(o_orderkey) - 100 AS distance FROM orders GROUP BY 1""")
def build_distance(t, spark):
    """The latest build of each version in a JSON list, and how far a local one lies behind."""
    lists = t("orders").groupBy(col("o_orderstatus").alias("version")).agg(F.to_json(F.collect_list(F.struct(col("o_orderkey").alias("build")))).alias("json"))
    return lists.select("version", C.latest_build(col("json")).alias("latest")).withColumn("distance", col("latest") - 100)


@query("""SELECT n_nationkey, n_name, r_name, c.n AS customers FROM nation JOIN region ON r_regionkey = n_regionkey JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey""")
def file_formats(t, spark):
    """Tables written as ORC, CSV and JSON and joined from there."""
    orc, csv, json = (scratch_dir(spark) for _ in range(3))
    t("nation").write.orc(orc)
    t("region").write.option("header", True).csv(csv)
    t("customer").select("c_custkey", "c_nationkey").write.json(json)
    n = spark.read.orc(orc)
    r = spark.read.option("header", True).schema("r_regionkey int, r_name string").csv(csv)
    c = spark.read.schema("c_custkey long, c_nationkey int").json(json).groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return n.join(r, n.n_regionkey == r.r_regionkey).join(c, n.n_nationkey == c.c_nationkey).select("n_nationkey", "n_name", "r_name", "customers")
