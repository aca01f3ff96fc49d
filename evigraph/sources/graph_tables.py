"""The order tables as a directed multigraph of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.sources.workspace import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edge(df: DataFrame, src: str, relation: str, dst: str, score, time_id=None, ord_=None) -> DataFrame:
    (a, x), (b, y) = src.split(":"), dst.split(":")
    return df.select(
        F.concat(F.lit(f"{a}:"), F.col(x).cast("string")).alias("src"),
        F.lit(relation).alias("relation"),
        F.concat(F.lit(f"{b}:"), F.col(y).cast("string")).alias("dst"),
        (F.lit("0") if time_id is None else time_id).alias("time_id"),
        score.cast("double").alias("score"),
        (F.lit(0) if ord_ is None else ord_).cast("int").alias("ord"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, relation, dst, time_id, score, ord; parallel edges differ in ord."""
    one = F.lit(1.0)
    lines = table(spark, sf_dir, "lineitem")
    # nearly every line has a pair of its own, so grouping before the shuffle would only hold all lines of a file's part in memory
    priced = dealt(lines.select("l_partkey", "l_suppkey", (1 - F.col("l_discount")).alias("_s")), "l_partkey", "l_suppkey")
    supplied = priced.groupBy("l_partkey", "l_suppkey").agg(F.max("_s").alias("s"))
    parts = [
        _edge(table(spark, sf_dir, "nation"), "nation:n_nationkey", "in_region", "region:n_regionkey", one),
        _edge(table(spark, sf_dir, "customer"), "customer:c_custkey", "of_nation", "nation:c_nationkey", one),
        _edge(table(spark, sf_dir, "supplier"), "supplier:s_suppkey", "of_nation", "nation:s_nationkey", one),
        _edge(table(spark, sf_dir, "orders"), "order:o_orderkey", "placed_by", "customer:o_custkey", one, F.date_format("o_orderdate", "yyyy-MM-dd")),
        _edge(lines, "order:l_orderkey", "contains", "part:l_partkey", F.least(F.col("l_quantity") / 50, F.lit(1.0)), ord_=F.col("l_linenumber")),
        _edge(supplied, "part:l_partkey", "supplied_by", "supplier:l_suppkey", F.col("s")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_key, type, name of every declared entity and of every end of an edge without one."""
    declared = [
        ("region", "r_regionkey", F.col("r_name")),
        ("nation", "n_nationkey", F.col("n_name")),
        ("customer", "c_custkey", F.col("c_name")),
        ("supplier", "s_suppkey", F.col("s_name")),
        ("part", "p_partkey", F.col("p_name")),
        ("orders", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))),
    ]
    out = None
    for name, key, label in declared:
        kind = name.removesuffix("s") if name == "orders" else name
        part = table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_key"), F.lit(kind).alias("type"), label.alias("name"))
        out = part if out is None else out.unionByName(part)
    ends = edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("node_key")).distinct()
    extra = ends.join(out.select("node_key"), "node_key", "left_anti").select("node_key", F.split_part("node_key", F.lit(":"), F.lit(1)).alias("type"), F.col("node_key").alias("name"))
    return out.unionByName(extra)


#: The same edges as common table expressions.
EDGES_SQL = """
sup AS (SELECT l_partkey, l_suppkey, max(1 - l_discount) AS s FROM lineitem GROUP BY l_partkey, l_suppkey),
edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'in_region' AS relation, 'region:' || n_regionkey AS dst, '0' AS time_id, 1.0::DOUBLE AS score, 0 AS ord FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'of_nation', 'nation:' || c_nationkey, '0', 1.0, 0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'of_nation', 'nation:' || s_nationkey, '0', 1.0, 0 FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, strftime(o_orderdate, '%Y-%m-%d'), 1.0, 0 FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey, '0', least(l_quantity / 50, 1.0), l_linenumber FROM lineitem
  UNION ALL SELECT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey, '0', s, 0 FROM sup
)"""
NODES_SQL = """
declared AS (
  SELECT 'region:' || r_regionkey AS node_key, 'region' AS type, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'Order ' || o_orderkey FROM orders
), ends AS (SELECT src AS node_key FROM edges UNION SELECT dst FROM edges),
nodes AS (
  SELECT * FROM declared
  UNION ALL SELECT node_key, split_part(node_key, ':', 1), node_key FROM ends WHERE node_key NOT IN (SELECT node_key FROM declared)
)"""
