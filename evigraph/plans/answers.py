"""Evidence and answering queries: for every supplier, how it is related to its nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import answering as A
from evigraph.operators import evidence as E
from evigraph.plans import graph
from evigraph.sources.graph_tables import EDGES_SQL, NODES_SQL, edges, nodes, table


def questions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b = F.concat(F.lit("supplier:"), F.col("s_suppkey")), F.concat(F.lit("nation:"), F.col("s_nationkey"))
    return s.select(F.col("s_suppkey").alias("query_id"), F.array(a, b).alias("entities"), F.concat(F.lit("How is "), a, F.lit(" related to "), b).alias("query"))


def _fused(spark, sf_dir):
    return E.retrieve(edges(spark, sf_dir), questions(spark, sf_dir))


def _selected(spark, sf_dir):
    return E.select_evidence(E.score_evidence(_fused(spark, sf_dir), questions(spark, sf_dir)))


_COLS = ["query_id", "evidence_type", "source_entity", "relation", "target_entity", "text"]


def kg_retrieve_evidence(spark, sf_dir):
    return _fused(spark, sf_dir).select(*_COLS, F.round("score", 6).alias("score"), "rank")


def ev_type_counts(spark, sf_dir):
    return _fused(spark, sf_dir).groupBy("evidence_type").agg(F.count(F.lit(1)).alias("n"))


def ev_semantic_score(spark, sf_dir):
    return E.score_evidence(_fused(spark, sf_dir), questions(spark, sf_dir)).select(*_COLS, F.round("semantic_score", 6).alias("semantic_score"))


def ev_selected(spark, sf_dir):
    return _selected(spark, sf_dir).filter("selected").select(*_COLS, "sel_rank")


def ev_rejected(spark, sf_dir):
    return _selected(spark, sf_dir).filter("not selected").select(*_COLS)


def _verdicts(spark, sf_dir, selected):
    return E.answerability(questions(spark, sf_dir), selected)


def ev_answerability(spark, sf_dir):
    return _verdicts(spark, sf_dir, _selected(spark, sf_dir)).withColumn("semantic", F.round("semantic", 6))


def ev_reasoning_confidence(spark, sf_dir):
    s, _ = E.search.settle(_selected(spark, sf_dir).filter("selected"), "selected")
    return E.reasoning(s, _verdicts(spark, sf_dir, s)).withColumn("confidence", F.round("confidence", 6))


def ev_citations(spark, sf_dir):
    return E.citations(_selected(spark, sf_dir))


def ev_text_block(spark, sf_dir):
    return E.evidence_text(_selected(spark, sf_dir))


def ans_display(spark, sf_dir):
    return nodes(spark, sf_dir).select("node_key", A.display(F.col("name")).alias("name"))


def ans_intent(spark, sf_dir):
    """What every message of the conversations asks for."""
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", A.intent(F.col("text")).alias("i"))
    return asked.select("conv_id", "turn", "role", F.col("i.group").alias("relation_group"), F.col("i.label").alias("answer_label"))


def ans_compose(spark, sf_dir):
    out = A.answer(questions(spark, sf_dir), _fused(spark, sf_dir))
    return out.select("query_id", "answer", "generation_type", "answerability", F.round("semantic_score", 6).alias("semantic_score"), F.size("citations").alias("n_citations"))


def kg_evidence_dedup(spark, sf_dir):
    """Every supplier's neighbours as evidence, each edge once though both of its ends ask for it."""
    q = questions(spark, sf_dir)
    seeds = q.select("query_id", F.explode("entities").alias("entity"))
    found = E.search.neighbor_search(edges(spark, sf_dir), seeds.select(F.col("entity").alias("query_id"), "entity").distinct(), "both", 10).drop("query_id", "rank")
    return E.fuse(E.from_neighbors(seeds.join(found, "entity"))).select(*_COLS, F.round("score", 6).alias("score"), "rank")


def kg_evidence_ids(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "evidence_type", "rank", E.evidence_id().alias("evidence_id"))


def ev_subgraph(spark, sf_dir):
    """The edges around every supplier as evidence."""
    return E.fuse(E.from_subgraph(graph.kg_subgraph_edges(spark, sf_dir))).select(*_COLS, F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (ev_subgraph, kg_evidence_ids, ans_display, ans_intent, ans_compose, kg_evidence_dedup, kg_retrieve_evidence, ev_type_counts, ev_semantic_score, ev_selected, ev_rejected, ev_answerability, ev_reasoning_confidence, ev_citations, ev_text_block)}


def _light(x):
    return f"trim(regexp_replace(translate(lower({x}), '_-', '  '), '\\s+', ' ', 'g'))"


_STOPS = "[" + ", ".join(f"'{s}'" for s in E.T.EVIDENCE_STOPS) + "]"


def _toks(x):
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-zA-Z0-9_]{{2,}}'), lambda t: NOT list_contains({_STOPS}, t)))".replace("{{", "{").replace("}}", "}")


_SQL = f"""
WITH {EDGES_SQL},
q AS (SELECT s_suppkey AS query_id, 'supplier:' || s_suppkey AS a, 'nation:' || s_nationkey AS b, 'How is supplier:' || s_suppkey || ' related to nation:' || s_nationkey AS query FROM supplier),
rel AS (SELECT query_id, 'relation' AS evidence_type, src AS source_entity, relation, dst AS target_entity, []::VARCHAR[] AS path, score, src || ' --' || relation || '--> ' || dst AS text FROM q JOIN edges ON src = a AND dst = b
  UNION ALL SELECT query_id, 'relation', src, relation, dst, []::VARCHAR[], score, src || ' --' || relation || '--> ' || dst FROM q JOIN edges ON src = b AND dst = a),
pat AS (SELECT query_id, 'path', a, 'path', b, [a, b], 0.9::DOUBLE, a || ' --' || relation || '--> ' || b FROM q JOIN edges ON src = a AND dst = b),
seeds AS (SELECT DISTINCT entity FROM (SELECT a AS entity FROM q UNION ALL SELECT b FROM q)),
f AS (SELECT entity, e.*, 0 AS place FROM seeds JOIN edges e ON entity = src UNION ALL SELECT entity, e.*, 1 FROM seeds JOIN edges e ON entity = dst),
o AS (SELECT entity, src, relation, dst, place, arg_min(score, {{'o': ord, 's': -score}}) AS score FROM f GROUP BY ALL),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, place, src, relation, dst) AS k FROM o) WHERE k <= 10),
nei AS (SELECT DISTINCT query_id, 'neighbor', src, relation, dst, []::VARCHAR[], score, src || ' --' || relation || '--> ' || dst FROM q JOIN nb ON entity IN (a, b)),
ev AS (SELECT * FROM rel UNION ALL SELECT * FROM pat UNION ALL SELECT * FROM nei),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE evidence_type WHEN 'relation' THEN 5 WHEN 'path' THEN 4 ELSE 2 END DESC, score DESC, source_entity, relation, target_entity) AS rank FROM ev) WHERE rank <= 30),
parts AS (SELECT fused.*, query, {_toks('query')} AS qt, {_toks('text')} AS tt,
    list_transform(list_concat([source_entity, target_entity, relation], path, CASE WHEN evidence_type = 'path' THEN [source_entity, 'of_nation', target_entity] ELSE [source_entity, relation, target_entity] END), lambda x: {_light('x')}) AS names, {_light('query')} AS ql FROM fused JOIN q USING (query_id)),
scored AS (SELECT *, round(0.35::DOUBLE * score + 0.2::DOUBLE * CASE evidence_type WHEN 'relation' THEN 1 WHEN 'path' THEN 0.78::DOUBLE ELSE 0.58::DOUBLE END
    + 0.25::DOUBLE * (0.4::DOUBLE * len(list_intersect(qt, tt)) / len(list_distinct(list_concat(qt, tt))) + 0.6::DOUBLE * len(list_intersect(qt, tt)) / len(qt))
    + 0.15::DOUBLE * len(list_filter(names, lambda x: contains(ql, x) OR contains(x, ql))) / len(names)
    + 0.05::DOUBLE * CASE WHEN evidence_type = 'relation' THEN 1 ELSE 0.4::DOUBLE END, 9) AS semantic_score FROM parts),
sel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, rank) AS sel_rank FROM scored),
chosen AS (SELECT * FROM sel WHERE semantic_score >= 0.15 AND sel_rank <= 8),
agg AS (SELECT query_id, count(*) AS n_selected, sum(CASE WHEN sel_rank <= 5 THEN semantic_score / sel_rank END) / sum(CASE WHEN sel_rank <= 5 THEN 1.0::DOUBLE / sel_rank END) AS s FROM chosen GROUP BY query_id),
ver AS (SELECT q.query_id, coalesce(n_selected, 0) AS n_selected, round(coalesce(s, 0), 9) AS semantic,
    CASE WHEN coalesce(n_selected, 0) = 0 THEN 'unanswerable' WHEN s >= 0.55 THEN 'answerable' WHEN s >= 0.25 THEN 'uncertain' ELSE 'unanswerable' END AS answerability FROM q LEFT JOIN agg USING (query_id)),
five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE evidence_type WHEN 'relation' THEN 4 WHEN 'path' THEN 3 ELSE 2 END DESC, semantic_score DESC, rank) AS r5 FROM chosen) WHERE r5 <= 5),
conf AS (SELECT query_id, count(*) AS n_steps, avg(semantic_score) AS m, max(CASE WHEN evidence_type = 'relation' THEN 1 ELSE 0 END) AS rel, max(CASE WHEN evidence_type = 'path' THEN 1 ELSE 0 END) AS pat FROM five GROUP BY query_id)
"""
_SMALL = ", ".join(f"'{w}'" for w in A.SMALL_WORDS)
_DISPLAY = f"""CASE WHEN contains(t, ' ') OR contains(t, '·') THEN t WHEN len(list_filter(string_split(replace(t, '-', '_'), '_'), lambda p: p <> '')) = 0 THEN replace(t, '-', '_')
    ELSE array_to_string(list_transform(list_filter(string_split(replace(t, '-', '_'), '_'), lambda p: p <> ''), lambda p, i: CASE WHEN i > 1 AND lower(p) IN ({_SMALL}) THEN lower(p) ELSE upper(p[1]) || p[2:] END), ' ') END"""
_ASKED = "trim(regexp_replace(translate(lower(trim(text)), '_', ' '), '\\s+', ' ', 'g'))"


def _case(value):
    rules = " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in words) + f" THEN '{value(group, label)}'" for group, label, words in A.INTENTS)
    return f"CASE {rules} END"


_NAME = "upper({0}[1]) || {0}[2:]"
_C = "query_id, evidence_type, source_entity, relation, target_entity, text"
ORACLES = {
    "kg_evidence_ids": f"""{_SQL} SELECT query_id, evidence_type, rank, 'ev_' || substr(md5(evidence_type || chr(1) || source_entity || chr(1) || relation || chr(1) || target_entity || chr(1)
        || coalesce(array_to_string(path, chr(2)), '') || chr(1) || text), 1, 12) AS evidence_id FROM fused""",
    "ans_display": f"WITH {EDGES_SQL}, {NODES_SQL}, d AS (SELECT node_key, trim(name) AS t FROM nodes) SELECT node_key, {_DISPLAY} AS name FROM d",
    "ans_intent": f"WITH d AS (SELECT conv_id, turn, role, {_ASKED} AS q FROM conversations) SELECT conv_id, turn, role, {_case(lambda g, l: g)} AS relation_group, {_case(lambda g, l: l)} AS answer_label FROM d",
    "ans_compose": f"""{_SQL}, rels AS (SELECT query_id, string_agg({_NAME.format('source_entity')} || ' 与 ' || {_NAME.format('target_entity')} || ' 之间存在“' || relation || '”关系', '；' ORDER BY k) AS r
          FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sel_rank) AS k FROM chosen WHERE evidence_type = 'relation') WHERE k <= 3 GROUP BY query_id),
        bas AS (SELECT query_id, string_agg(sel_rank || '. ' || text, ' ' ORDER BY sel_rank) AS b FROM chosen WHERE sel_rank <= 3 GROUP BY query_id)
        SELECT query_id, CASE answerability WHEN 'answerable' THEN '{A.SURE}' ELSE '{A.GENERIC_UNSURE}' END || r || '。' || CASE answerability WHEN 'uncertain' THEN chr(10) || chr(10) || '{A.CAUTION}' ELSE '' END
          || chr(10) || chr(10) || '依据是：' || b AS answer, 'rule' AS generation_type, answerability, round(semantic, 6) AS semantic_score, n_selected AS n_citations
        FROM ver JOIN rels USING (query_id) JOIN bas USING (query_id)""",
    "ev_subgraph": f"""WITH g AS ({graph.ORACLES["kg_subgraph_edges"]}), e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY head, relation, tail) AS rank FROM g)
        SELECT query_id, 'subgraph' AS evidence_type, head AS source_entity, relation, tail AS target_entity, head || ' --' || relation || '--> ' || tail AS text, 0.6::DOUBLE AS score, rank FROM e WHERE rank <= 30""",
    "kg_evidence_dedup": f"""{_SQL}, n AS (SELECT query_id, 'neighbor' AS evidence_type, src AS source_entity, relation, dst AS target_entity, src || ' --' || relation || '--> ' || dst AS text, max(score) AS score FROM q JOIN nb ON entity IN (a, b) GROUP BY ALL)
        SELECT * FROM (SELECT {_C}, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_entity, relation, target_entity) AS rank FROM n) WHERE rank <= 30""",
    "kg_retrieve_evidence": f"{_SQL} SELECT {_C}, round(score, 6) AS score, rank FROM fused",
    "ev_type_counts": f"{_SQL} SELECT evidence_type, count(*) AS n FROM fused GROUP BY 1",
    "ev_semantic_score": f"{_SQL} SELECT {_C}, round(semantic_score, 6) AS semantic_score FROM scored",
    "ev_selected": f"{_SQL} SELECT {_C}, sel_rank FROM chosen",
    "ev_rejected": f"{_SQL} SELECT {_C} FROM sel WHERE NOT (semantic_score >= 0.15 AND sel_rank <= 8)",
    "ev_answerability": f"{_SQL} SELECT query_id, n_selected, round(semantic, 6) AS semantic, answerability FROM ver",
    "ev_reasoning_confidence": f"""{_SQL} SELECT query_id, coalesce(n_steps, 0) AS n_steps, answerability, round(least(1, greatest(0, 0.45::DOUBLE * coalesce(m, 0) + 0.4::DOUBLE * semantic + 0.12::DOUBLE * coalesce(rel, 0) + 0.06::DOUBLE * coalesce(pat, 0)
        + CASE answerability WHEN 'answerable' THEN 0.12::DOUBLE WHEN 'uncertain' THEN 0.02::DOUBLE ELSE -0.2::DOUBLE END)), 6) AS confidence FROM ver LEFT JOIN conf USING (query_id)""",
    "ev_citations": f"{_SQL} SELECT query_id, 'E' || sel_rank AS citation, evidence_type, text FROM chosen",
    "ev_text_block": f"{_SQL} SELECT query_id, string_agg(format('[E{{}}] ({{}}, score={{:.3f}}) {{}}', sel_rank, evidence_type, score, text), chr(10) ORDER BY sel_rank) AS block FROM chosen GROUP BY query_id",
}
