"""Retrieval queries over documents, benchmark and embeddings, with the same results in SQL.

Searches take as queries every vector whose id is divisible by 20, or every benchmark item,
against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import ivf
from evigraph.operators import retrieval as R
from evigraph.sources.graph_tables import table
from evigraph.sources.workspace import folder


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _nearest(df):
    return df.select("query_id", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


def vec_knn_l2sq(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _nearest(R.knn(v.filter("id % 20 = 0"), v, 10))


def vec_knn_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _nearest(R.knn(v.filter("id % 20 = 0"), v, 10, "cosine"))


def vec_knn_where(spark, sf_dir):
    """Filtered before the search: only vectors of label 3."""
    v = _vectors(spark, sf_dir)
    return _nearest(R.knn(v.filter("id % 20 = 0"), v.filter("label = 3"), 10))


def vec_ivf_search(spark, sf_dir):
    """Exact search through an index of all vectors, cell by cell."""
    v = _vectors(spark, sf_dir)
    return _nearest(ivf.search(v.filter("id % 20 = 0"), ivf.build(v, folder(spark, "cells"), metric="cosine"), 10, exact=True))


def vec_ivf_recall(spark, sf_dir):
    """How much of the ten nearest vectors a search finds in as many cells as other vectors needed, against the whole scan."""
    v = _vectors(spark, sf_dir)
    q, index = v.filter("id % 20 = 0"), ivf.build(v, folder(spark, "cells"), metric="cosine")
    found = ivf.search(q, index, 10, ivf.tune(v.filter("id % 20 <> 0"), index, 10))
    return ivf.recall(found, R.knn(q, v, 10, "cosine"), 10)


def vec_margin_select(spark, sf_dir):
    """Automatic selection of the best other vector: its score and its lead over the next one."""
    v = _vectors(spark, sf_dir)
    near = R.knn(v.filter("id % 20 = 0"), v, 3, "cosine").filter("id <> query_id")
    top = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("h"))
    s1, s2 = -F.col("h")[0]["s"], F.coalesce(-F.get("h", 1)["s"], F.lit(0.0))
    chosen = (F.round(s1, 9) >= 0.72) & (F.round(s1 - s2, 9) >= 0.05)
    return top.select("query_id", F.col("h")[0]["id"].alias("id"), F.round(s1, 6).alias("score"), F.round(s1 - s2, 6).alias("margin"), F.when(chosen, "selected").otherwise("need_confirmation").alias("status"))


def txt_tokenize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text"), T.KEYWORD_STOPS).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5"))


def txt_inverted_index(spark, sf_dir):
    return R.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text")


def txt_hash_embedding(spark, sf_dir):
    return R.hash_embedding(table(spark, sf_dir, "benchmark"), "item_id", "text", 64).withColumn("value", F.round("value", 6))


def _keyword(spark, sf_dir, k=10):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return queries, docs, R.keyword_search(queries, docs, k)


def txt_keyword_search(spark, sf_dir):
    return _keyword(spark, sf_dir)[2].withColumn("score", F.round("score", 6))


def hyb_merge(spark, sf_dir):
    """Keyword hits of documents merged with vector hits of vectors that bear the same number."""
    hits = _keyword(spark, sf_dir)[2].select("query_id", "id", F.lit("keyword").alias("channel"), "score")
    v = _vectors(spark, sf_dir)
    near = R.knn(v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi"), v, 20).select("query_id", "id", F.lit("vector").alias("channel"), "score")
    return R.merge_channels(hits.unionByName(near)).drop("channel", "raw_scores").withColumn("score", F.round("score", 6))


def hyb_rerank(spark, sf_dir):
    queries, docs, hits = _keyword(spark, sf_dir)
    c = hits.drop("rank").join(queries, "query_id").join(docs, "id").withColumns({"n_sources": F.lit(1), "channel": F.lit("keyword")})
    return R.rerank(c).withColumn("rerank_score", F.round("rerank_score", 6))


def _channels(spark, sf_dir):
    queries, docs, hits = _keyword(spark, sf_dir)
    v = _vectors(spark, sf_dir)
    near = R.knn(v.join(queries.select(F.col("query_id").alias("id")), "id", "left_semi"), v, 20)
    return queries, docs, {"keyword": hits, "vector": near, "entity": near.filter("rank <= 5")}


def hyb_three_channels(spark, sf_dir):
    """Keyword hits, vector hits and, as entities, the five nearest vectors; hits below 0.2 go."""
    out = R.hybrid(_channels(spark, sf_dir)[2], 10, 0.2)
    raw = F.col("raw_scores")
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "n_sources", "channel", F.round(F.coalesce(raw["keyword"], F.lit(0.0)), 6).alias("keyword_score"), F.round(F.coalesce(raw["vector"], F.lit(0.0)), 6).alias("vector_score"), "rank")


def hyb_retrieve_rerank(spark, sf_dir):
    return R.retrieve_and_rerank(*_channels(spark, sf_dir)).withColumn("rerank_score", F.round("rerank_score", 6))


def hyb_blend(spark, sf_dir):
    """Re-ranked keyword hits blended with given scores, here a number drawn from the length of the text."""
    given = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.length("text") % 17).cast("double").alias("ce_score"))
    return R.blend(hyb_rerank(spark, sf_dir).join(given, "id"), "ce_score", k=5).withColumn("blended", F.round("blended", 6))


QUERIES = {f.__name__: f for f in (vec_knn_l2sq, vec_knn_cosine, vec_knn_where, vec_ivf_search, vec_ivf_recall, vec_margin_select, txt_tokenize, txt_inverted_index, txt_hash_embedding, txt_keyword_search, hyb_merge, hyb_rerank, hyb_three_channels, hyb_retrieve_rerank, hyb_blend)}

_KSTOPS = "[" + ", ".join(f"'{s}'" for s in T.KEYWORD_STOPS) + "]"
_RSTOPS = "[" + ", ".join(f"'{s}'" for s in T.RERANK_STOPS) + "]"


def _light(x):
    return f"trim(regexp_replace(translate(lower(coalesce({x}, '')), '_-', '  '), '\\s+', ' ', 'g'))"


def _tokens(x, stops):
    found = f"regexp_extract_all({_light(x)}, '[a-zA-Z0-9_]+')"
    return f"list_filter({found}, lambda t, i: list_position({found}, t) = i AND NOT list_contains({stops}, t))"


_VEC = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_L2 = "round(greatest(list_dot_product(q.e, q.e) + list_dot_product(v.e, v.e) - 2 * list_dot_product(q.e, v.e), 0), 9)"
_COS = "round(1 - list_cosine_similarity(q.e, v.e), 9)"


def _knn_sql(distance, k, queries="q.id % 20 = 0", where="true"):
    return f"""d AS (SELECT q.id AS query_id, v.id, {distance} AS distance FROM v q, v WHERE {queries} AND {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
    , n AS (SELECT query_id, id, round(distance, 6) AS distance, round(least(greatest(1 - distance, 0), 1), 6) AS score, greatest(least(1 - distance, 1), 0) AS s, rank FROM r WHERE rank <= {k})"""


_NEAR = "SELECT query_id, id, distance, score, rank FROM n"
_KEYWORD = f"""q AS (SELECT item_id AS query_id, text AS query, {_tokens('text', _KSTOPS)} AS t FROM benchmark),
    dt AS (SELECT doc_id AS id, text, list_distinct(list_filter(regexp_extract_all({_light('text')}, '[a-zA-Z0-9_]+'), lambda t: NOT list_contains({_KSTOPS}, t))) AS t, {_light('text')} AS b FROM documents),
    p AS (SELECT query_id, id, len(list_intersect(q.t, dt.t)) AS o, len(q.t) AS nq, len(dt.t) AS nd, contains(b, array_to_string(q.t, ' ')) AS phrase,
                 CASE WHEN len(list_intersect(q.t, dt.t)) = 0 THEN len(list_filter(q.t, lambda x: contains(b, x))) ELSE 0 END AS h FROM q, dt),
    s AS (SELECT query_id, id, round(CASE WHEN nq = 0 OR nd = 0 THEN 0 WHEN o > 0 THEN least(1, 0.65::DOUBLE * o / nq + 0.25::DOUBLE * o / nd + CASE WHEN phrase THEN 0.1::DOUBLE ELSE 0 END)
                 WHEN h > 0 THEN least(1, 0.25::DOUBLE + 0.1::DOUBLE * h) ELSE 0 END, 9) AS score FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0)"""
ORACLES = {
    "vec_knn_l2sq": f"WITH {_VEC}, {_knn_sql(_L2, 10)} {_NEAR}",
    "vec_knn_cosine": f"WITH {_VEC}, {_knn_sql(_COS, 10)} {_NEAR}",
    "vec_knn_where": f"WITH {_VEC}, {_knn_sql(_L2, 10, where='v.label = 3')} {_NEAR}",
    "vec_ivf_search": f"WITH {_VEC}, {_knn_sql(_COS, 10)} {_NEAR}",
    "vec_margin_select": f"""WITH {_VEC}, {_knn_sql(_COS, 3)}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM n WHERE id <> query_id),
        t AS (SELECT a.query_id, a.id, a.s AS s1, coalesce(b.s, 0) AS s2 FROM o a LEFT JOIN o b ON a.query_id = b.query_id AND b.k = 2 WHERE a.k = 1)
        SELECT query_id, id, round(s1, 6) AS score, round(s1 - s2, 6) AS margin, CASE WHEN round(s1, 9) >= 0.72 AND round(s1 - s2, 9) >= 0.05 THEN 'selected' ELSE 'need_confirmation' END AS status FROM t""",
    "txt_tokenize": f"""WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all({_light('text')}, '[a-zA-Z0-9_]+'), lambda t: NOT list_contains({_KSTOPS}, t))) AS t FROM documents)
        SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM d""",
    "txt_inverted_index": f"""WITH d AS (SELECT unnest(list_distinct(list_filter(regexp_extract_all({_light('text')}, '[a-zA-Z0-9_]+'), lambda t: NOT list_contains({_KSTOPS}, t)))) AS token FROM documents)
        SELECT token, count(*) AS n_docs FROM d GROUP BY token""",
    "txt_hash_embedding": """WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM benchmark),
        c AS (SELECT item_id, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INT AS idx, sum(CASE WHEN ('0x' || substr(md5(token), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS s FROM t GROUP BY 1, 2)
        SELECT item_id, idx, round(s / sqrt(sum(s * s) OVER (PARTITION BY item_id)), 6) AS value FROM c WHERE s <> 0""",
    "txt_keyword_search": f"WITH {_KEYWORD} SELECT query_id, id, round(score, 6) AS score, rank FROM k WHERE rank <= 10",
    "hyb_merge": f"""WITH {_VEC}, {_KEYWORD}, {_knn_sql(_L2, 20, queries='q.id IN (SELECT item_id FROM benchmark)')},
        h AS (SELECT query_id, id, 'keyword' AS c, 0.1::DOUBLE * score AS w FROM k WHERE rank <= 10 UNION ALL SELECT query_id, id, 'vector', 0.6::DOUBLE * s FROM n),
        m AS (SELECT query_id, id, count(DISTINCT c) AS n_sources, round(least(1, greatest(0, sum(w) * (1 + 0.08::DOUBLE * (count(DISTINCT c) - 1)))), 9) AS score FROM h GROUP BY ALL),
        z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m)
        SELECT query_id, id, round(score, 6) AS score, n_sources, rank FROM z WHERE rank <= 10""",
    "hyb_rerank": f"""WITH {_KEYWORD}, c AS (SELECT k.query_id, k.id, k.score, q.query, dt.text, {_tokens('q.query', _RSTOPS)} AS qt,
            list_distinct(list_filter(regexp_extract_all(dt.b, '[a-zA-Z0-9_]+'), lambda t: NOT list_contains({_RSTOPS}, t))) AS tt, dt.b FROM k JOIN q USING (query_id) JOIN dt USING (id) WHERE rank <= 10),
        f AS (SELECT *, len(list_intersect(qt, tt)) AS o, len(list_filter(qt, lambda x: contains(b, x))) AS h, length(trim(text)) AS n FROM c),
        g AS (SELECT query_id, id, round(0.45::DOUBLE * score + 0.25::DOUBLE * CASE WHEN len(qt) = 0 OR len(tt) = 0 THEN 0 WHEN o > 0 THEN 0.75::DOUBLE * o / len(qt) + 0.25::DOUBLE * o / len(tt) WHEN h > 0 THEN least(1, 0.2::DOUBLE + 0.1::DOUBLE * h) ELSE 0 END
            + 0.10::DOUBLE * 0.65::DOUBLE + 0.05::DOUBLE * CASE WHEN n = 0 THEN 0 WHEN n BETWEEN 40 AND 500 THEN 1 WHEN n BETWEEN 15 AND 39 OR n BETWEEN 501 AND 1200 THEN 0.75::DOUBLE WHEN n < 15 THEN 0.45::DOUBLE ELSE 0.55::DOUBLE END, 9) AS s FROM f),
        z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM g)
        SELECT query_id, id, round(s, 6) AS rerank_score, rank FROM z WHERE rank <= 8""",
}

_HYBRID = f"""WITH {_VEC}, {_KEYWORD}, {_knn_sql(_L2, 20, queries='q.id IN (SELECT item_id FROM benchmark)')},
    hits AS (SELECT query_id, id, 'keyword' AS c, score AS raw, 0.1::DOUBLE AS w FROM k WHERE rank <= 10 UNION ALL SELECT query_id, id, 'vector', s, 0.6::DOUBLE FROM n UNION ALL SELECT query_id, id, 'entity', s, 0.3::DOUBLE FROM n WHERE rank <= 5),
    m AS (SELECT query_id, id, count(DISTINCT c) AS n_sources, min(c) AS channel, coalesce(max(raw) FILTER (c = 'keyword'), 0) AS ks, coalesce(max(raw) FILTER (c = 'vector'), 0) AS vs,
        round(least(1, greatest(0, sum(raw * w) * (1 + 0.08::DOUBLE * (count(DISTINCT c) - 1)))), 9) AS score FROM hits GROUP BY query_id, id)"""
_SOURCE = "CASE WHEN n_sources >= 2 THEN 1.0::DOUBLE WHEN channel = 'entity' THEN 0.9::DOUBLE WHEN channel = 'vector' THEN 0.8::DOUBLE WHEN channel = 'keyword' THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END"
_RANKED = ORACLES["hyb_rerank"][ORACLES["hyb_rerank"].index("f AS (") :].replace("0.10::DOUBLE * 0.65::DOUBLE", f"0.10::DOUBLE * {_SOURCE}")
ORACLES["hyb_three_channels"] = f"""{_HYBRID} SELECT query_id, id, round(score, 6) AS score, n_sources, channel, round(ks, 6) AS keyword_score, round(vs, 6) AS vector_score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m WHERE score >= 0.2::DOUBLE QUALIFY rank <= 10"""
ORACLES["hyb_retrieve_rerank"] = f"""{_HYBRID}, best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10),
    c AS (SELECT best.query_id, best.id, best.score, n_sources, channel, q.query, dt.text, {_tokens('q.query', _RSTOPS)} AS qt,
        list_distinct(list_filter(regexp_extract_all(dt.b, '[a-zA-Z0-9_]+'), lambda t: NOT list_contains({_RSTOPS}, t))) AS tt, dt.b FROM best JOIN q USING (query_id) JOIN dt USING (id)), {_RANKED}"""
ORACLES["hyb_blend"] = f"""WITH h AS ({ORACLES["hyb_rerank"]}), j AS (SELECT query_id, id, rerank_score, (length(text) % 17)::DOUBLE AS ce FROM h JOIN documents ON doc_id = id),
    x AS (SELECT *, min(ce) OVER w AS lo, max(ce) OVER w AS hi FROM j WINDOW w AS (PARTITION BY query_id)),
    y AS (SELECT query_id, id, round(0.65::DOUBLE * CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (ce - lo) / (hi - lo) END + 0.35::DOUBLE * rerank_score, 9) AS b FROM x)
    SELECT query_id, id, round(b, 6) AS blended, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, id) AS rank FROM y QUALIFY rank <= 5"""
