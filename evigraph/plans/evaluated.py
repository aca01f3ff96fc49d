"""An evaluation run over the documents, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import evaluation as V
from evigraph.operators import evaluation_run as E
from evigraph.plans.records import _BARE, _PLAIN
from evigraph.sources.graph_tables import table


def eval_run_by_group(spark, sf_dir):
    """Every document as a record; the labelled ones have cases that expect a word, keywords, a route and an answerability."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    records = d.select(
        F.col("doc_id").alias("case_id"), F.col("text").alias("answer"), F.when(F.col("lang") == "en", "kg_rag").otherwise("direct_llm").alias("route"), F.col("source").alias("answerability"), (F.col("doc_id") % 7 == 0).alias("has_error"),
        F.col("n_chars").alias("latency_ms"), (F.col("doc_id") % 4).alias("num_evidence"), (F.col("doc_id") % 3).alias("num_grounded_entities"), F.lit(0).alias("num_warnings"),
    )
    j = d.join(lab, "doc_id")
    cases = j.select(
        F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, " The, ").alias("reference_answer"), F.array(F.lit("the"), F.lit("!"), F.lit("de la"), "lang").alias("keywords"),
        F.when(F.col("quality") == 1, " KG_RAG").alias("expected_route"), F.when(F.col("toxic") == 1, "web").otherwise(F.col("source")).alias("expected_answerability"), F.col("lang").alias("category"), F.when(F.col("toxic") == 1, "hard").alias("difficulty"),
    )
    return E.summarize(E.attach(records, V.require_unique_cases(cases)))


QUERIES = {"eval_run_by_group": eval_run_by_group}
_SAID, _THE = _BARE.format("text"), "'the'"
_VALUES = ", ".join(
    [f"{{'metric': '{m}', 'logical': true, 'v': ({v})::INT::DOUBLE}}" for m, v in {
        "has_error": "doc_id % 7 = 0", "has_answer": "trim(coalesce(text, '')) <> ''", "has_evidence": "doc_id % 4 > 0", "has_grounded_entities": "doc_id % 3 > 0",
        "exact_match": "CASE WHEN ref IS NOT NULL THEN said <> '' AND said = ref END", "contains_match": "CASE WHEN ref IS NOT NULL THEN said <> '' AND contains(said, ref) END",
        "route_match": "CASE WHEN quality = 1 THEN route = 'kg_rag' END", "answerability_match": f"CASE WHEN wanted <> '' THEN wanted = {_PLAIN.format('source')} END",
    }.items()]
    + [f"{{'metric': '{m}', 'logical': false, 'v': ({v})::DOUBLE}}" for m, v in {
        "keyword_recall": "CASE WHEN said = '' OR quality IS NULL THEN 0 ELSE (contains(said, 'the')::INT + contains(said, 'de la')::INT + coalesce(contains(said, lang)::INT, 0)) / (2 + (lang IS NOT NULL)::INT) END",
        "latency_ms": "n_chars", "num_evidence": "doc_id % 4", "num_grounded_entities": "doc_id % 3", "num_warnings": "0",
    }.items()]
)
ORACLES = {
    "eval_run_by_group": f"""WITH b AS (SELECT doc_id, text, lang, source, n_chars, quality, toxic, {_SAID} AS said, CASE WHEN lang = 'en' THEN 'kg_rag' ELSE 'direct_llm' END AS route FROM documents LEFT JOIN labels USING (doc_id)),
        c AS (SELECT *, CASE WHEN quality IS NULL THEN NULL WHEN doc_id % 3 = 0 AND {_PLAIN.format('text')} <> '' THEN said WHEN doc_id % 3 = 1 THEN {_THE} END AS ref, CASE WHEN quality IS NOT NULL THEN CASE WHEN toxic = 1 THEN 'web' ELSE {_PLAIN.format('source')} END END AS wanted FROM b),
        u AS (SELECT coalesce(CASE WHEN quality IS NOT NULL THEN lang END, 'general') AS category, CASE WHEN toxic = 1 THEN 'hard' ELSE 'normal' END AS difficulty, route, coalesce(source, '') AS answerability, unnest([{_VALUES}], recursive := true) FROM c),
        g AS (SELECT metric, logical, category, difficulty, route, answerability, grouping(category) AS gc, grouping(difficulty) AS gd, grouping(route) AS gr, grouping(answerability) AS ga, count(v) AS n, sum(v) AS hit, avg(v) AS a, min(v) AS lo, max(v) AS hi,
            quantile_cont(v, 0.5) AS q1, quantile_cont(v, 0.9) AS q2, quantile_cont(v, 0.95) AS q3 FROM u GROUP BY GROUPING SETS ((metric, logical), (metric, logical, category), (metric, logical, difficulty), (metric, logical, route), (metric, logical, answerability)))
        SELECT CASE 0 WHEN gc THEN 'category' WHEN gd THEN 'difficulty' WHEN gr THEN 'route' WHEN ga THEN 'answerability' ELSE 'all' END AS group_by, coalesce(category, difficulty, route, answerability, '') AS "group", metric, n,
        CASE WHEN logical THEN coalesce(hit, 0)::BIGINT END AS hit, CASE WHEN logical THEN round_even(a, 4) ELSE round_even(coalesce(a, 0), 4) END AS avg, {", ".join(f"CASE WHEN NOT logical THEN round_even(coalesce({c}, 0), 4) END AS {n}" for c, n in (("lo", "min"), ("hi", "max"), ("q1", "p50"), ("q2", "p90"), ("q3", "p95")))} FROM g""",
}
