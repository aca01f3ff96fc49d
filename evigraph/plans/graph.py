"""Graph queries over the order tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import search
from evigraph.sources.graph_tables import EDGES_SQL, NODES_SQL, edges, nodes, table


def _keyed(df, prefix, key, out):
    return df.select(F.col(key).cast("long").alias("query_id"), F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias(out))


def order_part_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return lines.select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("query_id"), F.concat(F.lit("order:"), F.col("l_orderkey")).alias("source"), F.concat(F.lit("part:"), F.col("l_partkey")).alias("target"))


def order_region_pairs(spark, sf_dir):
    orders = _keyed(table(spark, sf_dir, "orders"), "order", "o_orderkey", "source")
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey")).alias("target"))
    return orders.crossJoin(F.broadcast(regions))  # five regions, whatever the scale


def part_region_pairs(spark, sf_dir):
    parts = _keyed(table(spark, sf_dir, "part"), "part", "p_partkey", "source")
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey")).alias("target"))
    return parts.crossJoin(F.broadcast(regions))


def kg_edges_view(spark, sf_dir):
    return edges(spark, sf_dir).withColumn("score", F.round("score", 6))


def kg_nodes_view(spark, sf_dir):
    return nodes(spark, sf_dir)


def kg_graph_stats(spark, sf_dir):
    return search.graph_stats(nodes(spark, sf_dir), edges(spark, sf_dir))


def kg_degree_topk(spark, sf_dir):
    d = search.degrees(edges(spark, sf_dir)).withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    return d.orderBy(F.desc("degree"), "node").limit(20)


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


def kg_relation_search(spark, sf_dir):
    return _rounded(search.relation_search(edges(spark, sf_dir), order_part_pairs(spark, sf_dir)))


def kg_relation_reverse(spark, sf_dir):
    pairs = order_part_pairs(spark, sf_dir).select("query_id", F.col("target").alias("source"), F.col("source").alias("target"))
    return _rounded(search.relation_search(edges(spark, sf_dir), pairs))


def kg_neighbors_out(spark, sf_dir):
    return _rounded(search.neighbor_search(edges(spark, sf_dir), _keyed(table(spark, sf_dir, "orders"), "order", "o_orderkey", "entity"), "out"))


def kg_neighbors_in(spark, sf_dir):
    return _rounded(search.neighbor_search(edges(spark, sf_dir), _keyed(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "entity"), "in"))


def kg_neighbors_both(spark, sf_dir):
    return _rounded(search.neighbor_search(edges(spark, sf_dir), _keyed(table(spark, sf_dir, "customer"), "customer", "c_custkey", "entity"), "both"))


def _paths(df):
    return df.select("query_id", "source", "target", F.array_join("path", " > ").alias("path"), "path_length", "num_hops", "score", "rank")


def kg_paths_directed(spark, sf_dir):
    return _paths(search.path_search(edges(spark, sf_dir), order_region_pairs(spark, sf_dir)))


def kg_paths_topk(spark, sf_dir):
    return _paths(search.path_search(edges(spark, sf_dir), part_region_pairs(spark, sf_dir), max_nodes=4, max_paths=5))


def kg_shortest_path(spark, sf_dir):
    return _paths(search.path_search(edges(spark, sf_dir), part_region_pairs(spark, sf_dir), max_nodes=4, max_paths=1))


def _subgraph(spark, sf_dir):
    return search.subgraph_search(edges(spark, sf_dir), _keyed(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "entity"))


def kg_subgraph_nodes(spark, sf_dir):
    return _subgraph(spark, sf_dir)[0]


def kg_subgraph_edges(spark, sf_dir):
    return _subgraph(spark, sf_dir)[1]


def kg_entity_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("part:"), F.col("l_partkey")).alias("entity"))
    return search.entity_pairs(lines, "query_id", "entity")


QUERIES = {f.__name__: f for f in (
    kg_edges_view, kg_nodes_view, kg_graph_stats, kg_degree_topk, kg_relation_search, kg_relation_reverse, kg_neighbors_out, kg_neighbors_in, kg_neighbors_both,
    kg_paths_directed, kg_paths_topk, kg_shortest_path, kg_subgraph_nodes, kg_subgraph_edges, kg_entity_pairs,
)}

_TEXT = "src || ' --' || relation || '--> ' || dst"


def _relation_sql(swap: bool) -> str:
    a, b = ("'part:' || l_partkey", "'order:' || l_orderkey") if swap else ("'order:' || l_orderkey", "'part:' || l_partkey")
    return f"""
    WITH {EDGES_SQL}, pairs AS (
      SELECT DISTINCT l_orderkey || '-' || l_partkey AS query_id, {a} AS source, {b} AS target FROM lineitem
    ), f AS (
      SELECT query_id, e.*, 'forward' AS direction, 0 AS place FROM pairs JOIN edges e ON source = src AND target = dst
      UNION ALL SELECT query_id, e.*, 'reverse', 1 FROM pairs JOIN edges e ON target = src AND source = dst
    ), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, src, relation, dst, direction ORDER BY ord, score DESC) AS r FROM f),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, relation, src, dst) AS k FROM o WHERE r = 1)
    SELECT query_id, src AS head, relation, dst AS tail, direction, round(score, 6) AS score, {_TEXT} AS text FROM c WHERE k <= 20
    """


def _neighbor_sql(seed: str, directions: str) -> str:
    parts = {
        "out": "SELECT query_id, entity, e.*, dst AS neighbor, 'out' AS direction, 0 AS place FROM seeds JOIN edges e ON entity = src",
        "in": "SELECT query_id, entity, e.*, src AS neighbor, 'in' AS direction, 1 AS place FROM seeds JOIN edges e ON entity = dst",
    }
    return f"""
    WITH {EDGES_SQL}, seeds AS ({seed}), f AS ({' UNION ALL '.join(parts[d] for d in directions.split())}),
    o AS (SELECT query_id, entity, src, relation, dst, direction, place, neighbor, arg_min(score, {{'o': ord, 's': -score}}) AS score FROM f GROUP BY ALL),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, src, relation, dst) AS rank FROM o)
    SELECT query_id, entity, src AS source, relation, dst AS target, neighbor, direction, round(score, 6) AS score, {_TEXT} AS text, rank FROM c WHERE rank <= 20
    """


def _path_sql(source: str, limit: int) -> str:
    return f"""
    WITH RECURSIVE {EDGES_SQL}, step AS (SELECT DISTINCT src AS node, dst AS next FROM edges),
    sources AS ({source}), walk AS (
      SELECT query_id, source, source AS node, [source] AS path FROM sources
      UNION ALL SELECT query_id, source, next, list_append(path, next) FROM walk JOIN step USING (node) WHERE len(path) < 4 AND NOT list_contains(path, next)
    ), c AS (
      SELECT query_id, source, node AS target, path, len(path) AS path_length, row_number() OVER (PARTITION BY query_id, source, node ORDER BY len(path), path) AS rank
      FROM walk WHERE node LIKE 'region:%'
    )
    SELECT query_id, source, target, array_to_string(path, ' > ') AS path, path_length, path_length - 1 AS num_hops,
           CASE path_length WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.82 WHEN 4 THEN 0.74 END::DOUBLE AS score, rank
    FROM c WHERE rank <= {limit}
    """


_PARTS = "SELECT p_partkey AS query_id, 'part:' || p_partkey AS source FROM part"
_SUBGRAPH_SQL = f"""
    WITH {EDGES_SQL}, step AS (SELECT src AS node, dst AS next FROM edges UNION SELECT dst, src FROM edges),
    l0 AS (SELECT s_suppkey AS query_id, 'supplier:' || s_suppkey AS id, 0 AS depth FROM supplier WHERE 'supplier:' || s_suppkey IN (SELECT node FROM step)),
    n1 AS (SELECT DISTINCT query_id, next AS id, 1 AS depth FROM l0 JOIN step ON id = node WHERE next <> id),
    f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, id) AS r FROM (SELECT * FROM l0 UNION ALL SELECT * FROM n1)) WHERE r <= 50),
    n2 AS (SELECT DISTINCT f1.query_id, next AS id, 2 AS depth FROM f1 JOIN step ON f1.id = node WHERE depth = 1 AND (f1.query_id, next) NOT IN (SELECT query_id, id FROM f1)),
    nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, id) AS r FROM (SELECT query_id, id, depth FROM f1 UNION ALL SELECT * FROM n2)) WHERE r <= 50)
"""
ORACLES = {
    "kg_edges_view": f"WITH {EDGES_SQL} SELECT src, relation, dst, time_id, round(score, 6) AS score, ord FROM edges",
    "kg_nodes_view": f"WITH {EDGES_SQL}, {NODES_SQL} SELECT * FROM nodes",
    "kg_graph_stats": f"""WITH {EDGES_SQL}, {NODES_SQL}
        SELECT 'total' AS kind, 'nodes' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges
        UNION ALL SELECT 'node_type', * FROM (SELECT type, count(*) AS n FROM nodes GROUP BY type ORDER BY n DESC, type LIMIT 20)
        UNION ALL SELECT 'relation', * FROM (SELECT relation, count(*) AS n FROM edges GROUP BY relation ORDER BY n DESC, relation LIMIT 20)""",
    "kg_degree_topk": f"""WITH {EDGES_SQL}, d AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges)
        SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM d GROUP BY node ORDER BY degree DESC, node LIMIT 20""",
    "kg_relation_search": _relation_sql(False),
    "kg_relation_reverse": _relation_sql(True),
    "kg_neighbors_out": _neighbor_sql("SELECT o_orderkey AS query_id, 'order:' || o_orderkey AS entity FROM orders", "out"),
    "kg_neighbors_in": _neighbor_sql("SELECT s_suppkey AS query_id, 'supplier:' || s_suppkey AS entity FROM supplier", "in"),
    "kg_neighbors_both": _neighbor_sql("SELECT c_custkey AS query_id, 'customer:' || c_custkey AS entity FROM customer", "out in"),
    "kg_paths_directed": _path_sql("SELECT o_orderkey AS query_id, 'order:' || o_orderkey AS source FROM orders", 5),
    "kg_paths_topk": _path_sql(_PARTS, 5),
    "kg_shortest_path": _path_sql(_PARTS, 1),
    "kg_subgraph_nodes": _SUBGRAPH_SQL + "SELECT query_id, id, depth, depth = 0 AS is_center FROM nodes",
    "kg_subgraph_edges": _SUBGRAPH_SQL + """, k AS (
        SELECT a.query_id, e.*, row_number() OVER (PARTITION BY a.query_id ORDER BY relation, src, dst, ord) AS r
        FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst AND b.query_id = a.query_id)
        SELECT DISTINCT query_id, src AS head, relation, dst AS tail FROM k WHERE r <= 100""",
    "kg_entity_pairs": """WITH m AS (SELECT DISTINCT l_orderkey AS query_id, 'part:' || l_partkey AS entity FROM lineitem)
        SELECT a.query_id, a.entity AS source, b.entity AS target FROM m a JOIN m b ON a.query_id = b.query_id AND a.entity < b.entity""",
}
