"""A graph view over the driver's star schema, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _line(key: str):
    return (F.col(key) % 100 + 1).cast("int")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers, parts and orders as nodes of one graph; community: the region."""
    t = lambda name: table(spark, sf_dir, name)
    region, nation = F.broadcast(t("region")), t("nation")
    place = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey))
    make = lambda d, id, label, kind, file, line, comm: d.select(F.lit("star").alias("graph"), id.alias("id"), label.alias("label"), F.lit(kind).alias("kind"), file.alias("file"), line.alias("line"), comm.cast("int").alias("community"))
    here = F.concat_ws("/", "r_name", "n_name")
    c = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    s = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    o = t("orders").join(c.select("c_custkey", "n_regionkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = [
        make(t("region"), _id("region", "r_regionkey"), F.col("r_name"), "module", F.col("r_name"), F.lit(1), F.col("r_regionkey")),
        make(place, _id("nation", "n_nationkey"), F.col("n_name"), "class", here, F.lit(1), F.col("n_regionkey")),
        make(c, _id("customer", "c_custkey"), F.col("c_name"), "function", F.concat(here, F.lit("/customers")), _line("c_custkey"), F.col("n_regionkey")),
        make(s, _id("supplier", "s_suppkey"), F.col("s_name"), "method", F.concat(here, F.lit("/suppliers")), _line("s_suppkey"), F.col("n_regionkey")),
        make(t("part"), _id("part", "p_partkey"), F.col("p_name"), "doc", F.concat(F.lit("parts/"), F.col("p_brand")), _line("p_partkey"), F.lit(-1)),
        make(o, _id("orders", "o_orderkey"), F.concat(F.lit("Order-"), F.col("o_orderkey").cast("string")), "file", F.concat(F.lit("orders/"), F.col("o_orderpriority")), _line("o_orderkey"), F.col("n_regionkey")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    make = lambda d, a, b, relation, conf=F.lit("EXTRACTED"): d.select(F.lit("star").alias("graph"), a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"), conf.alias("confidence"))
    conf = F.when(F.col("l_returnflag") == "A", F.lit("EXTRACTED")).when(F.col("l_returnflag") == "N", F.lit("INFERRED")).otherwise(F.lit("AMBIGUOUS"))
    out = make(t("nation"), _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "contains")
    out = out.union(make(t("customer"), _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "contains"))
    out = out.union(make(t("supplier"), _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "contains"))
    out = out.union(make(t("orders"), _id("orders", "o_orderkey"), _id("customer", "o_custkey"), "references"))
    calls = lambda key: t("lineitem").select("l_orderkey", key, conf.alias("conf")).distinct()
    out = out.union(make(calls("l_partkey"), _id("orders", "l_orderkey"), _id("part", "l_partkey"), "imports", F.col("conf")))
    return out.union(make(calls("l_suppkey"), _id("orders", "l_orderkey"), _id("supplier", "l_suppkey"), "calls", F.col("conf")))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as services: suppliers provide stock routes and queues, customers consume them."""
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    key = lambda kind, method, n: F.when(kind == "queue", F.concat(F.lit("stock."), n.cast("string"))).otherwise(F.concat(method, F.lit(" /stock/"), n.cast("string")))

    def make(d, direction, kind, method, n, node, line):
        return d.select(F.col("n_name").alias("service"), F.lit(direction).alias("direction"), kind.alias("kind"), key(kind, method, n).alias("key"), key(kind, method, n).alias("display"), node.alias("node"), F.lit("data").alias("file"), line.alias("line"), F.lit("INFERRED").alias("confidence"), F.lit("route" if direction == "provides" else "client").alias("source"))

    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sk = F.when(F.col("s_suppkey") % 3 == 0, F.lit("queue")).otherwise(F.lit("http"))
    ck = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("queue")).otherwise(F.lit("http"))
    method = F.when(F.col("c_custkey") % 7 == 0, F.lit("POST")).otherwise(F.lit("GET"))
    out = make(s, "provides", sk, F.lit("GET"), F.col("s_suppkey") % 83, _id("supplier", "s_suppkey"), F.col("s_suppkey").cast("int"))
    return out.unionByName(make(c, "consumes", ck, method, F.col("c_custkey") % 97, _id("customer", "c_custkey"), F.col("c_custkey").cast("int")))


NODES_SQL = """nodes AS (
 SELECT 'star' AS graph, 'region:' || r_regionkey AS id, r_name AS label, 'module' AS kind, r_name AS file, 1 AS line, r_regionkey AS community FROM region
 UNION ALL SELECT 'star', 'nation:' || n_nationkey, n_name, 'class', r_name || '/' || n_name, 1, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'star', 'customer:' || c_custkey, c_name, 'function', r_name || '/' || n_name || '/customers', CAST(c_custkey % 100 + 1 AS INT), n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'star', 'supplier:' || s_suppkey, s_name, 'method', r_name || '/' || n_name || '/suppliers', CAST(s_suppkey % 100 + 1 AS INT), n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'star', 'part:' || p_partkey, p_name, 'doc', 'parts/' || p_brand, CAST(p_partkey % 100 + 1 AS INT), -1 FROM part
 UNION ALL SELECT 'star', 'orders:' || o_orderkey, 'Order-' || o_orderkey, 'file', 'orders/' || o_orderpriority, CAST(o_orderkey % 100 + 1 AS INT), n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

_CONF = "CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'AMBIGUOUS' END"
EDGES_SQL = f"""edges AS (
 SELECT 'star' AS graph, 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS relation, 'EXTRACTED' AS confidence FROM nation
 UNION ALL SELECT 'star', 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 'EXTRACTED' FROM customer
 UNION ALL SELECT 'star', 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 'EXTRACTED' FROM supplier
 UNION ALL SELECT 'star', 'orders:' || o_orderkey, 'customer:' || o_custkey, 'references', 'EXTRACTED' FROM orders
 UNION ALL (SELECT DISTINCT 'star', 'orders:' || l_orderkey, 'part:' || l_partkey, 'imports', {_CONF} FROM lineitem)
 UNION ALL (SELECT DISTINCT 'star', 'orders:' || l_orderkey, 'supplier:' || l_suppkey, 'calls', {_CONF} FROM lineitem))"""

ENDPOINTS_SQL = """eps AS (
 SELECT n_name AS service, 'provides' AS direction, CASE WHEN s_suppkey % 3 = 0 THEN 'queue' ELSE 'http' END AS kind,
  CASE WHEN s_suppkey % 3 = 0 THEN 'stock.' || (s_suppkey % 83) ELSE 'GET /stock/' || (s_suppkey % 83) END AS key, 'supplier:' || s_suppkey AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT n_name, 'consumes', CASE WHEN c_mktsegment = 'BUILDING' THEN 'queue' ELSE 'http' END,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'stock.' || (c_custkey % 97) ELSE CASE WHEN c_custkey % 7 = 0 THEN 'POST' ELSE 'GET' END || ' /stock/' || (c_custkey % 97) END, 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
 cons AS (SELECT * FROM eps WHERE direction = 'consumes'), prov AS (SELECT * FROM eps WHERE direction = 'provides'),
 exact AS (SELECT c.service, c.kind, c.node, c.key AS ckey, p.service AS p_service, p.key AS key, p.node AS p_node, false AS path_only FROM cons c JOIN prov p ON c.kind = p.kind AND c.key = p.key AND c.service <> p.service),
 paths AS (SELECT c.service, c.kind, c.node, c.key AS ckey, p.service AS p_service, p.key AS key, p.node AS p_node, true AS path_only FROM cons c JOIN prov p ON c.kind = 'http' AND p.kind = 'http'
  AND substr(c.key, instr(c.key, ' ') + 1) = substr(p.key, instr(p.key, ' ') + 1) AND c.service <> p.service WHERE c.node NOT IN (SELECT node FROM exact)),
 pairs AS (SELECT *, count(*) OVER (PARTITION BY node) AS n FROM (SELECT * FROM exact UNION ALL SELECT * FROM paths))"""
