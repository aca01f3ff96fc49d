"""Mixed JSON records made of the tables, brought to one shape, with the same results in SQL that knows how each was made."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.sources import normalize as N
from evigraph.sources.graph_tables import table


def _shapes(key, shapes):
    out = None
    for k, shape in enumerate(shapes):
        test = F.pmod(key, F.lit(len(shapes))) == k
        out = F.when(test, shape) if out is None else out.when(test, shape)
    return out


def _object(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _documents(spark, sf_dir):
    """Documents as six kinds of records: two of texts, a text alone, one of odd names, one of a title, and a list, which is none."""
    d = table(spark, sf_dir, "documents")
    key, text = F.col("doc_id"), F.col("text")
    whole = _object(t=text)
    return d.select("doc_id", _shapes(key, [
        _object(text=text, doc_id=key, score=F.col("n_chars") / 1000),
        _object(text=F.lit(" "), content=text, metadata=F.struct("lang", "n_chars"), distance=F.lit(0.25), extra=F.col("source")),
        F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6)),
        _object(page_content=text, id=F.lit(""), document_id=F.concat(F.lit("d"), key), similarity=F.lit("0.5")),
        F.concat(F.lit('{"score": null, "metadata": "none", "name": "'), F.coalesce("source", F.lit("")), F.lit('"}')),
        F.lit("[1, 2]"),
    ]).alias("record"))


def etl_normalize_hits(spark, sf_dir):
    out = N.hits(_documents(spark, sf_dir), "record", "vector", 0.1, ["doc_id"])
    return out.select("doc_id", "id", F.md5("text").alias("text_md5"), F.round("score", 6).alias("score"), "distance", F.try_element_at("metadata", F.lit("lang")).alias("lang"), F.size("metadata").alias("n_metadata"), F.array_join(F.array_sort(F.map_keys("rest")), ",").alias("rest"))


def etl_normalize_candidates(spark, sf_dir):
    """The same records as candidates for each kind of source."""
    d = _documents(spark, sf_dir).withColumn("part", F.col("doc_id") % 7)
    return N.candidates(d, "record", "part", "doc_id").select("part", "rank", "id", F.round("score", 6).alias("score"), "source")


def etl_normalize_entities(spark, sf_dir):
    """Customers and parts as records of entities under four sets of names."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("kind"))
    key, name, kind = F.col("k"), F.col("n"), F.col("kind")
    record = _shapes(key, [
        _object(entity_id=key, entity_name=name, type=kind, aliases=F.array(name, F.lit(" "), F.lower(name), name), metadata=F.struct(kind.alias("type"), F.lit("crm").alias("source"))),
        _object(id=key, label=name, category=kind, alias=F.concat(name, F.lit("; x；, y,x")), desc=F.lit("d")),
        _object(name=name),
        _object(node_key=F.concat(F.lit("n"), key), title=F.lit(" ")),
        F.lit('{"note": "no name"}'),
    ])
    out = N.entities(c.select("k", record.alias("record")), "record", ["k"])
    return out.select("k", "entity_id", "entity_name", "node_key", "type", F.array_join("aliases", "|").alias("aliases"), "description", F.element_at("metadata", "type").alias("meta_type"), F.element_at("metadata", "source").alias("meta_source"))


def etl_normalize_evidence(spark, sf_dir):
    """Line items as evidence: ends, a path, triples, a sentence and nothing."""
    li = table(spark, sf_dir, "lineitem")
    a, b, c = (F.concat(F.lit(p), F.col(k)) for p, k in (("o", "l_orderkey"), ("p", "l_partkey"), ("s", "l_suppkey")))
    record = _shapes(F.col("l_orderkey") + F.col("l_linenumber"), [
        _object(type=F.lit("relation"), head=a, rel=F.col("l_returnflag"), tail=b, weight=F.col("l_discount")),
        _object(path=F.array(a, b, c), confidence=F.lit(2)),
        _object(triples=F.array(F.struct(a.alias("head"), F.lit("has").alias("predicate"), b.alias("tail")), F.struct(b.alias("head"), F.lit(" ").alias("predicate"), c.alias("tail"))), evidence_type=F.lit("path")),
        _object(sentence=F.concat(F.lit(" "), a, F.lit(" ")), source=a),
        F.lit("{}"),
    ])
    out = N.evidence(li.select("l_orderkey", "l_linenumber", record.alias("record")), "record", ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "evidence_type", "source_entity", "target_entity", "relation", F.size("path").alias("n_path"), F.size("triples").alias("n_triples"), "text", F.round("score", 6).alias("score"), F.length("evidence_id").alias("id_length"))


def etl_edge_attributes(spark, sf_dir):
    """Line items as edges from orders to parts, whose attributes have five shapes."""
    li = table(spark, sf_dir, "lineitem")
    record = _shapes(F.col("l_orderkey") + F.col("l_linenumber"), [
        _object(predicate=F.col("l_returnflag"), weight=F.col("l_discount")),
        _object(label=F.col("l_linestatus"), score=F.lit("bad"), confidence=F.col("l_tax")),
        _object(value=F.col("l_suppkey"), text=F.lit("told")),
        F.lit(None).cast("string"),
        _object(relation=F.lit(" "), name=F.lit("named"), similarity=F.lit("7")),
    ])
    out = N.edges(li.select("l_orderkey", "l_linenumber", "l_partkey", record.alias("record")), "record", "l_orderkey", "l_partkey", ["l_linenumber"])
    return out.select("l_linenumber", "src", "dst", "relation", F.round("score", 6).alias("score"), "text", F.size("attributes").alias("n_attributes"))


def etl_event_fields(spark, sf_dir):
    """What fields the events' properties have, how often, and the sum of their numbers."""
    e = table(spark, sf_dir, "events").withColumn("_v", F.try_parse_json("props"))
    field = e.select("event_type", F.explode(N.rest_of(F.col("_v"), ())).alias("field", "value"))
    return field.groupBy("event_type", "field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").try_cast("long")).alias("total"))


QUERIES = {f.__name__: f for f in (etl_normalize_hits, etl_normalize_candidates, etl_normalize_entities, etl_normalize_evidence, etl_edge_attributes, etl_event_fields)}

_D = """d AS (SELECT doc_id, doc_id % 6 AS s, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t, trim(coalesce(source, '')) AS title, text, lang, n_chars FROM documents),
    h AS (SELECT *, CASE WHEN s = 4 THEN title ELSE t END AS x FROM d WHERE s < 5 AND NOT (s = 2 AND text IS NULL) AND CASE WHEN s = 4 THEN title ELSE t END <> '')"""
_L = "l AS (SELECT *, (l_orderkey + l_linenumber) % 5 AS s, 'o' || l_orderkey AS a, 'p' || l_partkey AS b, 's' || l_suppkey AS c FROM lineitem)"
ORACLES = {
    "etl_normalize_hits": f"""WITH {_D} SELECT doc_id, CASE s WHEN 0 THEN doc_id::VARCHAR WHEN 3 THEN 'd' || doc_id ELSE 'ret_' || substr(md5(x), 1, 16) END AS id, md5(x) AS text_md5,
        round(CASE s WHEN 0 THEN CASE WHEN n_chars IS NULL THEN 0.1 ELSE least(1, n_chars / 1000) END WHEN 1 THEN 0.75 WHEN 3 THEN 0.5 ELSE 0.1 END, 6)::DOUBLE AS score, CASE WHEN s = 1 THEN 0.25::DOUBLE END AS distance, CASE WHEN s = 1 THEN lang END AS lang,
        CASE WHEN s = 1 THEN (lang IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT ELSE 0 END AS n_metadata, CASE s WHEN 1 THEN 'extra' WHEN 4 THEN 'name' ELSE '' END AS rest FROM h""",
    "etl_normalize_candidates": f"""WITH {_D} SELECT doc_id % 7 AS part, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS rank, CASE s WHEN 0 THEN doc_id::VARCHAR WHEN 3 THEN 'd' || doc_id ELSE 'cand_' || substr(md5(x), 1, 16) END AS id,
        round(CASE s WHEN 0 THEN coalesce(least(1, n_chars / 1000), 0) WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 WHEN 3 THEN 0.5 ELSE 0 END, 6)::DOUBLE AS score, 'unknown' AS source FROM h""",
    "etl_normalize_entities": """WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS s, c_name AS n, c_mktsegment AS kind FROM customer)
        SELECT k, CASE s WHEN 2 THEN n WHEN 3 THEN 'n' || k ELSE k::VARCHAR END AS entity_id, CASE s WHEN 3 THEN 'n' || k ELSE n END AS entity_name, CASE s WHEN 2 THEN n WHEN 3 THEN 'n' || k ELSE k::VARCHAR END AS node_key,
        CASE WHEN s < 2 THEN kind ELSE 'entity' END AS type, CASE s WHEN 0 THEN n || '|' || lower(n) WHEN 1 THEN n || '|x|y' ELSE '' END AS aliases, CASE s WHEN 1 THEN 'd' ELSE '' END AS description,
        CASE WHEN s < 2 THEN kind ELSE 'entity' END AS meta_type, CASE s WHEN 0 THEN 'crm' ELSE 'vector_builder' END AS meta_source FROM c WHERE s < 4""",
    "etl_normalize_evidence": f"""WITH {_L} SELECT l_orderkey, l_linenumber, CASE s WHEN 0 THEN 'relation' WHEN 2 THEN 'path' ELSE 'text' END AS evidence_type, CASE WHEN s IN (0, 3) THEN a ELSE '' END AS source_entity, CASE WHEN s = 0 THEN b ELSE '' END AS target_entity,
        CASE WHEN s = 0 THEN l_returnflag ELSE '' END AS relation, CASE WHEN s = 1 THEN 3 ELSE 0 END AS n_path, CASE WHEN s = 2 THEN 2 ELSE 0 END AS n_triples,
        CASE s WHEN 0 THEN a || ' --' || l_returnflag || '--> ' || b WHEN 1 THEN a || ' -> ' || b || ' -> ' || c WHEN 2 THEN a || ' --has--> ' || b || '; ' || b || ' --related_to--> ' || c ELSE a END AS text,
        round(CASE s WHEN 0 THEN l_discount WHEN 1 THEN 1 ELSE 0 END, 6)::DOUBLE AS score, 15 AS id_length FROM l WHERE s < 4""",
    "etl_edge_attributes": f"""WITH {_L}, r AS (SELECT *, CASE s WHEN 0 THEN l_returnflag WHEN 1 THEN l_linestatus WHEN 2 THEN l_suppkey::VARCHAR WHEN 3 THEN 'related_to' ELSE 'named' END AS relation FROM l)
        SELECT l_linenumber, l_orderkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, relation, round(CASE s WHEN 0 THEN l_discount WHEN 1 THEN l_tax ELSE 1 END, 6)::DOUBLE AS score,
        CASE WHEN s = 2 THEN 'told' ELSE l_orderkey || ' --' || relation || '--> ' || l_partkey END AS text, CASE s WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 3 END AS n_attributes FROM r""",
    "etl_event_fields": """WITH k AS (SELECT event_type, props, unnest(json_keys(props)) AS field FROM events)
        SELECT event_type, field, count(*) AS n, sum(try_cast(json_extract_string(props, '$.' || field) AS BIGINT))::BIGINT AS total FROM k GROUP BY 1, 2""",
}
