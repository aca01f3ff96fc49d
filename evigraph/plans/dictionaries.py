"""Ids, alias maps and answers of a model over the order tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import told
from evigraph.sources import dictionaries as D
from evigraph.sources.graph_tables import EDGES_SQL, NODES_SQL, edges, nodes, table


def etl_entity_ids(spark, sf_dir):
    """Ids of all node keys, after the customers' have been given."""
    n = nodes(spark, sf_dir).select("node_key", "type")
    return D.dense_ids(n, "node_key", D.dense_ids(n.filter("type = 'customer'"), "node_key"))


def etl_relation_ids(spark, sf_dir):
    found = D.relations(D.dense_ids(edges(spark, sf_dir), "relation"))
    return found.select("relation_code", "internal_relation_id", "name", "description", F.col("metadata")["source"].alias("source"))


def _parts(spark, sf_dir):
    """Parts as entities, whose names, brands and types are shared; the number of a part is its place."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("entity_id"), F.col("p_name").alias("entity_name"), F.concat(F.lit("part:"), key).alias("node_key"), F.lit("").alias("type"), F.array("p_brand", F.concat(F.lit(" "), F.col("p_type"))).alias("aliases"), key.alias("ord")
    )


def _entries(df):
    return df.select("alias_key", "entity_id", "entity_name", "node_key", "type", F.array_join("aliases", "|").alias("aliases"))


def kg_alias_last(spark, sf_dir):
    return _entries(D.alias_entries(_parts(spark, sf_dir)))


def kg_alias_first(spark, sf_dir):
    return _entries(D.alias_entries(_parts(spark, sf_dir), True))


def kg_alias_shapes(spark, sf_dir):
    """Parts as alias records of three shapes: a name's entity, an entity's names, and an object."""
    k, shape = F.col("p_partkey"), F.pmod("p_partkey", F.lit(3))
    entity = F.concat(F.lit("Part "), k)
    told = F.concat(F.lit('"'), entity, F.lit('"'))
    whole = F.to_json(F.struct(F.lit(" ").alias("entity_name"), entity.alias("name"), F.concat(F.lit("part:"), k).alias("node_key"), F.col("p_brand").alias("aliases")))
    value = F.when(shape == 0, told).when(shape == 1, F.to_json(F.array("p_name", "p_type"))).otherwise(whole)
    return D.alias_map(table(spark, sf_dir, "part").select(F.when(shape == 1, entity).otherwise(F.col("p_name")).alias("key"), value.alias("value"), k.alias("ord")))


def er_told_mentions(spark, sf_dir):
    """Questions about customers and their nations with answers of four kinds: with places, without, broken, and several items."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    both = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    query = F.concat(F.lit("is "), "c_name", F.lit(" of "), "n_name")
    placed = F.to_json(F.array(F.struct(F.col("c_name").alias("text"), F.lit(3).alias("start"), (3 + F.length("c_name")).alias("end"), F.lit("person").alias("type"), F.lit(0.95).alias("confidence"))))
    found = F.to_json(F.array(F.struct(F.lower("n_name").alias("text"), F.lit("high").alias("confidence"))))
    several = F.concat(F.lit('[3, {"text": "'), F.col("c_name"), F.lit('"}, {"text": "nobody"}, {"text": "'), F.col("n_name"), F.lit('", "confidence": "0.5"}]'))
    shape = F.pmod("c_custkey", F.lit(4))
    output = F.when(shape == 0, F.concat(F.lit("Here they are:\n"), placed, F.lit("\nThat is all."))).when(shape == 1, found).when(shape == 2, F.concat(found, F.lit(" and [more"), F.lit("]"))).otherwise(several)
    return told.mentions(both.select(F.col("c_custkey").alias("query_id"), query.alias("query"), output.alias("output")))


QUERIES = {f.__name__: f for f in (etl_entity_ids, etl_relation_ids, kg_alias_last, kg_alias_first, kg_alias_shapes, er_told_mentions)}


def _alias_sql(pick):
    return f"""WITH e AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS entity_id, p_name AS entity_name, 'part:' || p_partkey AS node_key, p_brand || '| ' || p_type AS aliases, unnest([p_name, 'part:' || p_partkey, p_partkey::VARCHAR, p_brand, p_type]) AS a FROM part),
        l AS (SELECT * REPLACE (trim(a) AS a) FROM e UNION ALL SELECT * REPLACE (lower(trim(a)) AS a) FROM e), w AS (SELECT a, {pick}(k) AS k FROM l WHERE a <> '' GROUP BY a)
        SELECT DISTINCT w.a AS alias_key, entity_id, entity_name, node_key, 'entity' AS type, aliases FROM w JOIN e USING (k)"""


ORACLES = {
    "etl_entity_ids": f"""WITH {EDGES_SQL}, {NODES_SQL}, n AS (SELECT DISTINCT node_key, type = 'customer' AS first FROM nodes)
        SELECT node_key AS name, row_number() OVER (ORDER BY first DESC, node_key) - 1 AS id FROM n""",
    "etl_relation_ids": f"""WITH {EDGES_SQL}, r AS (SELECT DISTINCT relation FROM edges)
        SELECT relation AS relation_code, row_number() OVER (ORDER BY relation) - 1 AS internal_relation_id, relation AS name, '' AS description, 'raw_relation2ids' AS source FROM r""",
    "kg_alias_last": _alias_sql("max"),
    "kg_alias_first": _alias_sql("min"),
    "kg_alias_shapes": """WITH e AS (SELECT p_partkey AS k, 'Part ' || p_partkey AS entity_name, unnest(CASE p_partkey % 3 WHEN 0 THEN [p_name] WHEN 1 THEN ['Part ' || p_partkey, p_name, p_type]
            ELSE [p_name, 'Part ' || p_partkey, 'part:' || p_partkey, p_brand] END) AS a FROM part)
        SELECT lower(trim(a)) AS alias_key, arg_max(entity_name, k) AS entity_name FROM e GROUP BY 1""",
    "er_told_mentions": """WITH b AS (SELECT c_custkey AS query_id, c_custkey % 4 AS s, c_name AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT query_id, 0 AS ord, c AS mention, 3 AS start, 3 + length(c) AS "end", 'person' AS type, 0.95::DOUBLE AS confidence FROM b WHERE s = 0
        UNION ALL SELECT query_id, 0, lower(n), instr(lower('is ' || c || ' of ' || n), lower(n)) - 1, instr(lower('is ' || c || ' of ' || n), lower(n)) - 1 + length(n), 'unknown', 0.8::DOUBLE FROM b WHERE s = 1
        UNION ALL SELECT query_id, 1, c, 3, 3 + length(c), 'unknown', 0.8::DOUBLE FROM b WHERE s = 3
        UNION ALL SELECT query_id, 3, n, 7 + length(c), 7 + length(c) + length(n), 'unknown', 0.5::DOUBLE FROM b WHERE s = 3""",
}
