"""Summaries, memories and contexts of all sessions at once, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import context as C
from evigraph.plans.records import AS_OF, _messages, _tenants
from evigraph.sources.graph_tables import table
from evigraph.sources.workspace import folder
from evigraph.streaming.store import MemoryStore

#: Turns that the earlier summary covers; budgets so small that many texts are cut.
EARLY, SUMMARY_BUDGET, CONTEXT_BUDGET, MOST = 2, 150, 300, 3


def _early(spark, sf_dir):
    return C.summarize(_messages(spark, sf_dir).filter(F.col("turn") < EARLY), budget=SUMMARY_BUDGET).select("session", "summary")


def _requests(spark, sf_dir):
    """Each session asks with its last message of a user, among the memories of four sessions."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))
    none = F.lit("")
    user = F.floor(F.col("conv_id") / 4).cast("string")
    return c.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("session"), "query", F.lit("chat").alias("namespace"), user.alias("user_id"), none.alias("project_id"), none.alias("session_id"))


def _known(spark, sf_dir):
    """Memories with what they say: each message, of a kind and a confidence by its turn."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 2 == 0, "fact").otherwise("note")
    said = c.select(F.concat_ws("-", "conv_id", "turn", "role").alias("memory_id"), F.col("text").alias("content"), kind.alias("memory_type"), ((F.col("turn") % 4 + 1) / 5).alias("confidence"))
    return _tenants(spark, sf_dir).join(said, "memory_id")


def mem_summary_previous(spark, sf_dir):
    """Later messages summed up after the summary of the first two; sessions of two messages keep the old summary."""
    late = _messages(spark, sf_dir).filter(F.col("turn") >= EARLY)
    return C.summarize(late, _early(spark, sf_dir), SUMMARY_BUDGET).select("session", F.md5("summary").alias("summary_md5"), "estimated_tokens")


def mem_retrieve_requests(spark, sf_dir):
    out = C.retrieve_for(_requests(spark, sf_dir), _known(spark, sf_dir), AS_OF, MOST)
    return out.select("query_id", "memory_id", F.round("score", 6).alias("score"), "rank")


def mem_context(spark, sf_dir):
    """Contexts of all sessions: the early summary, the best memories, the last messages."""
    found = C.retrieve_for(_requests(spark, sf_dir), _known(spark, sf_dir), AS_OF, MOST)
    out = C.assemble(_requests(spark, sf_dir), _messages(spark, sf_dir), _early(spark, sf_dir), found, CONTEXT_BUDGET, 5)
    return out.select("query_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "estimated_tokens", "n_memories", "n_recent")


def mem_store_batches(spark, sf_dir):
    """A store after three batches of messages, the first of which comes again; every message comes twice, once with blanks around it."""
    c = table(spark, sf_dir, "conversations")
    none = F.lit("")
    turn = F.col("turn")
    d = c.select(
        F.lit("chat").alias("namespace"), F.floor(F.col("conv_id") / 4).cast("string").alias("user_id"), none.alias("project_id"), none.alias("session_id"), F.when(turn % 2 == 0, "fact").otherwise("note").alias("memory_type"),
        F.explode(F.array("text", F.concat(F.lit("  "), "text", F.lit(" ")))).alias("content"), F.col("role").alias("source"), ((turn % 4 + 1) / 5).alias("confidence"), (F.col("conv_id") * 1000 + turn).alias("ord"), F.create_map(F.concat(F.lit("turn"), turn), F.col("conv_id").cast("string")).alias("metadata"),
    )
    store = MemoryStore(spark, folder(spark, "memories"), 8)
    for batch in (0, 1, 0, 2):
        store.write(d.filter(F.pmod(F.floor(F.col("ord") / 1000), F.lit(3)) == batch), AS_OF, batch=batch)
    return store.read().select("user_id", "memory_type", F.md5("key").alias("key_md5"), F.md5("content").alias("content_md5"), "source", "confidence", "status", F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("metadata"))


QUERIES = {f.__name__: f for f in (mem_summary_previous, mem_retrieve_requests, mem_context, mem_store_batches)}


def _spent(t):
    plain = f"length(regexp_replace({t}, '[^\\x00-\\x7F]', '', 'g'))"
    return f"floor({plain} / 4 + (length({t}) - {plain}) / 1.5::DOUBLE)"


def _cut(t, budget):
    kept = f"len(list_filter(range(1, {4 * budget + 5}), lambda i: i <= length({t}) AND {_spent(f'substr({t}, 1, i)')} <= {budget}))"
    return f"CASE WHEN {_spent(t)} <= {budget} THEN {t} ELSE regexp_replace(substr({t}, 1, {kept}), '\\s+$', '') END"


def _strip(t):
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def _summed(rows, head):
    """The summary of rows (session, turn, role, x), after a heading."""
    role = "CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' ELSE role END"
    return f"""SELECT session, {head} || '{C.POINTS_HEAD}' || string_agg(chr(10) || '- ' || {role} || ': ' || {_cut('x', C.MESSAGE_TOKENS)}, '' ORDER BY turn) AS s
        FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS age FROM {rows}) WHERE age <= 12 GROUP BY session"""


_M = f"m AS (SELECT * FROM (SELECT conv_id AS session, turn, role, {_strip('text')} AS x FROM conversations) WHERE x <> '')"
_EARLY = f"{_M}, m0 AS (SELECT * FROM m WHERE turn < {EARLY}), s0 AS ({_summed('m0', chr(39) * 2)}), early AS (SELECT session, {_cut('s', SUMMARY_BUDGET)} AS s FROM s0)"
_FOUND = f"""mem AS (SELECT conv_id || '-' || turn || '-' || role AS memory_id, conv_id // 4 AS u, text AS content, CASE WHEN turn % 2 = 0 THEN 'fact' ELSE 'note' END AS kind, (turn % 4 + 1) / 5 AS conf, turn FROM conversations WHERE turn % 5 <> 0),
    asked AS (SELECT conv_id AS query_id, conv_id // 4 AS u, {_strip("lower(max_by(text, turn))")} AS q FROM conversations WHERE role = 'user' GROUP BY conv_id),
    pair AS (SELECT query_id, memory_id, content, kind, conf, turn, q, lower(content) AS c, list_distinct(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS b FROM asked JOIN mem USING (u)),
    scored AS (SELECT *, round(least(1, 0.72::DOUBLE * CASE WHEN q = '' THEN 0.35::DOUBLE WHEN contains(c, q) OR contains(q, c) THEN 1 ELSE len(list_intersect(a, b)) / greatest(1, len(list_distinct(a || b))) END + 0.18::DOUBLE * conf
        + 0.10::DOUBLE * exp(-(epoch_us(TIMESTAMP '{AS_OF}') - (1700000000 + turn * 86400) * 1000000) / 86400000000::DOUBLE / 180)), 9) AS score FROM pair),
    found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn DESC, memory_id) AS rank FROM scored WHERE score >= 0.15 QUALIFY rank <= {MOST})"""
ORACLES = {
    "mem_summary_previous": f"""WITH {_EARLY}, m1 AS (SELECT * FROM m WHERE turn >= {EARLY}), body AS ({_summed('m1', chr(39) * 2)}),
        whole AS (SELECT session, CASE WHEN body.s IS NULL THEN early.s ELSE coalesce('{C.BEFORE_HEAD}' || chr(10) || early.s || chr(10), '') || body.s END AS t FROM early FULL JOIN body USING (session)),
        z AS (SELECT session, {_cut('t', SUMMARY_BUDGET)} AS t FROM whole) SELECT session, md5(t) AS summary_md5, greatest(1, {_spent('t')})::INT AS estimated_tokens FROM z""",
    "mem_retrieve_requests": f"WITH {_FOUND} SELECT query_id, memory_id, round(score, 6) AS score, rank FROM found",
    "mem_context": f"""WITH {_EARLY}, {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS age FROM m QUALIFY age <= 5),
        a AS (SELECT query_id, '{C.MEMORY_HEAD}' || string_agg(chr(10) || '- (' || kind || ', ' || printf('%.3f', score) || ') ' || content, '' ORDER BY rank) AS t, count(*) AS n FROM found GROUP BY query_id),
        b AS (SELECT session AS query_id, '{C.RECENT_HEAD}' || string_agg(chr(10) || '- ' || role || ': ' || x, '' ORDER BY age DESC) AS t, count(*) AS n FROM r GROUP BY session),
        w AS (SELECT query_id, a.n AS na, b.n AS nb, array_to_string(list_filter(['{C.SUMMARY_HEAD}' || chr(10) || {_strip('early.s')}, a.t, b.t], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS t
            FROM asked LEFT JOIN early ON session = query_id LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)), z AS (SELECT *, {_cut('t', CONTEXT_BUDGET)} AS c FROM w)
        SELECT query_id, md5(c) AS text_md5, length(c)::INT AS n_chars, greatest(1, {_spent('c')})::INT AS estimated_tokens, coalesce(na, 0) AS n_memories, coalesce(nb, 0) AS n_recent FROM z""",
    "mem_store_batches": """WITH c AS (SELECT conv_id, turn, role, conv_id // 4 AS u, CASE WHEN turn % 2 = 0 THEN 'fact' ELSE 'note' END AS kind, (turn % 4 + 1) / 5 AS conf, unnest([text, '  ' || text || ' ']) AS t FROM conversations),
        k AS (SELECT *, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS x, trim(regexp_replace(lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')) AS key, conv_id * 1000 + turn AS ord, conv_id % 3 AS batch FROM c WHERE trim(t) <> '')
        SELECT u::VARCHAR AS user_id, kind AS memory_type, md5(key) AS key_md5, md5(first(x ORDER BY batch, ord, x)) AS content_md5, last(role ORDER BY batch, ord, role) AS source, max(conf) AS confidence, 'active' AS status,
        array_to_string(list_sort(list_distinct(list('turn' || turn))), ',') AS metadata FROM k GROUP BY u, kind, key""",
}
