"""Memory, evaluation, entity, event and table queries, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import evaluation as V
from evigraph.operators import memory as M
from evigraph.operators import mentions, resolve
from evigraph.sources import readers
from evigraph.sources.graph_tables import EDGES_SQL, NODES_SQL, nodes, table
from evigraph.streaming import sessions as S

AS_OF = "2030-01-01 00:00:00"


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


def _memories(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("memory_id"), F.col("conv_id").alias("scope"), F.lit("fact").alias("memory_type"), F.col("text").alias("content"), F.lit(0.8).alias("confidence"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 86400).alias("updated_at"))


def mem_recent_messages(spark, sf_dir):
    return M.recent_messages(_messages(spark, sf_dir), 5).select("session", "turn", "role", "age")


def mem_token_estimate(spark, sf_dir):
    return _messages(spark, sf_dir).select("session", "turn", "role", T.estimate_tokens(F.col("text")).cast("int").alias("n_tokens"))


def mem_summary(spark, sf_dir):
    return M.summarize(_messages(spark, sf_dir)).select("session", F.md5("summary").alias("summary_md5"), F.length("summary").alias("n_chars"))


def mem_lexical_retrieve(spark, sf_dir):
    out = M.retrieve(_memories(spark, sf_dir), "the of and that", AS_OF, 3)
    return out.select("scope", "memory_id", F.round("relevance", 6).alias("relevance"), "rank")


def mem_sensitive_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(T.sensitive(F.col("text")).alias("sensitive")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def mem_upsert(spark, sf_dir):
    m = _memories(spark, sf_dir)
    out = M.upsert(m.limit(0), m)
    return out.select("scope", "memory_type", F.md5("key").alias("key_md5"), "confidence", "n")


def mem_explicit_capture(spark, sf_dir):
    return M.explicit_capture(_messages(spark, sf_dir))


def _tenants(spark, sf_dir):
    """Each message as a memory of a user with four sessions; every second one belongs to its session, every fifth is superseded."""
    c = table(spark, sf_dir, "conversations")
    user = F.floor(F.col("conv_id") / 4).cast("string")
    own = F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string"))
    status = F.when(F.col("turn") % 5 == 0, "superseded").otherwise("active")
    return c.select(
        F.concat_ws("-", "conv_id", "turn", "role").alias("memory_id"), F.lit("chat").alias("namespace"), user.alias("user_id"), F.lit(None).cast("string").alias("project_id"), own.alias("session_id"),
        status.alias("status"), F.lit(None).cast("string").alias("expires_at"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 86400).alias("updated_at"),
    )


def mem_scoped(spark, sf_dir):
    """What each session sees of its user's memories; sessions of odd number ask for none in particular."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    session = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string"))
    asked = c.select(F.col("conv_id").alias("query_id"), F.lit("chat").alias("namespace"), F.floor(F.col("conv_id") / 4).cast("string").alias("user_id"), F.lit("").alias("project_id"), session.alias("session_id"))
    return M.scoped(_tenants(spark, sf_dir), asked, AS_OF).select("query_id", "memory_id", "rank")


def mem_supersede(spark, sf_dir):
    m = _memories(spark, sf_dir).withColumn("status", F.lit("active"))
    return M.supersede(m, m.filter("updated_at >= timestamp_seconds(1700000000 + 3 * 86400)")).select("memory_id", "scope", "status")


def mem_forget(spark, sf_dir):
    m = _memories(spark, sf_dir)
    return M.forget(m, m.filter("updated_at >= timestamp_seconds(1700000000 + 3 * 86400)")).select("memory_id", "scope")


def eval_run_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return V.run_summary(d.select((F.col("toxic") == 1).alias("has_error"), F.col("text").alias("answer"), F.col("quality").alias("num_evidence"), (F.col("n_chars") % 3).alias("num_grounded_entities")))


def er_clean_mention(spark, sf_dir):
    """The first three words of each document as a mention."""
    words = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 3), " ")
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("m"))
    return d.select("doc_id", T.clean_mention(F.col("m")).alias("mention"), T.valid_entity(F.col("m")).alias("valid"))


def er_node_key(spark, sf_dir):
    return nodes(spark, sf_dir).select("node_key", T.node_key(F.col("name")).alias("index_key"))


def vec_store_delete(spark, sf_dir):
    """The store after the vectors of label 3 with an id divisible by 4 are deleted."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return readers.delete_by(v, v.filter("vec_id % 4 = 0"), F.col("label") == 3, "vec_id")


def _cases(spark, sf_dir):
    """Each labelled document as a case: its first five words are asked for, and its own text answers."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "text", "lang", "quality", "toxic", F.slice(F.split(F.trim("text"), r"\s+"), 1, 5).alias("keywords"))


def eval_bool_summary(spark, sf_dir):
    return V.boolean_summary(table(spark, sf_dir, "labels").withColumn("ok", F.col("quality") == 1), "ok")


def eval_numeric_summary(spark, sf_dir):
    return V.numeric_summary(table(spark, sf_dir, "documents"), "n_chars")


def eval_keyword_recall(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", F.round(V.keyword_recall(F.col("text"), F.col("keywords")), 6).alias("recall"))


def eval_match_metrics(spark, sf_dir):
    c = _cases(spark, sf_dir).withColumn("reference", F.array_join("keywords", " "))
    return c.select("doc_id", V.exact_match(F.col("text"), F.col("reference")).alias("exact"), V.contains_match(F.col("text"), F.col("reference")).alias("contained"))


def eval_count_by_key(spark, sf_dir):
    return V.count_by_key(_cases(spark, sf_dir), "lang")


def er_normalize_mention(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", T.mention(F.col("n_name")).alias("mention"))


def er_router_label(spark, sf_dir):
    """Words end where its SQL ends them, at the first character beyond ASCII."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.route(F.col("text"), ascii_words=True).alias("route"))


def er_quoted_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.quoted(F.col("text"))).alias("pos", "mention"))


def er_proper_mentions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.proper_names(F.col("text"))).alias("pos", "mention"))


def kg_alias_map(spark, sf_dir):
    return resolve.aliases(nodes(spark, sf_dir))


def kg_alias_first_wins(spark, sf_dir):
    return resolve.aliases(nodes(spark, sf_dir), True)


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.lower(F.translate("n_name", "_", " ")).alias("mention"))


def er_alias_link(spark, sf_dir):
    return resolve.link(_mentions(spark, sf_dir), resolve.aliases(nodes(spark, sf_dir)))


def er_ground(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return resolve.ground(resolve.link(_mentions(spark, sf_dir), resolve.aliases(n)), n)


def _nations(spark, sf_dir):
    """The nations as entities, and mentions of them: an alias, a name within other words, and one that says little."""
    name, key = F.col("n_name"), F.col("n_nationkey")
    t = table(spark, sf_dir, "nation")
    said = F.when(key % 3 == 0, F.lower(name)).when(key % 3 == 1, F.concat_ws(" ", name, name, F.lit("land"))).otherwise(F.concat(F.lit("nation of "), name))
    return t.select(key.cast("long").alias("id"), F.concat(F.lit("nation:"), key).alias("node_key"), name.alias("name")), t.select(key.cast("long").alias("query_id"), said.alias("mention"))


def mem_write_reasons(spark, sf_dir):
    """Every message as a candidate, of types, users and confidences by its numbers, and why it is not written."""
    turn, conv = F.col("turn"), F.col("conv_id")
    kind = F.when(turn % 3 == 0, "fact").when(turn % 3 == 1, "preference").otherwise("rumour")
    c = table(spark, sf_dir, "conversations").select(
        conv.alias("scope"), turn.alias("ord"), F.when(conv % 7 != 0, conv.cast("string")).alias("user_id"), kind.alias("memory_type"), F.col("text").alias("content"), (turn % 4 / 4).alias("confidence")
    )
    return M.screen(c, 5).groupBy("scope", F.coalesce("reason", F.lit("written")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def er_extract(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Where was "), "c_name", F.lit(" born?")).alias("query"))
    return mentions.extract(c)


def er_link_candidates(spark, sf_dir):
    entities, said = _nations(spark, sf_dir)
    out = resolve.candidates(said, resolve.aliases(nodes(spark, sf_dir)), entities, resolve.name_search(entities), 3)
    return out.select("query_id", "mention", "rank", "node_key", F.round("score", 6).alias("score"), "source", "selected", "status")


def er_resolve(spark, sf_dir):
    """Questions that quote a nation, to nodes of the graph."""
    entities, n = _nations(spark, sf_dir)[0], nodes(spark, sf_dir)
    asked = entities.select(F.col("id").alias("query_id"), F.concat(F.lit('"'), "name", F.lit('" 是什么')).alias("query"))
    return resolve.resolve(asked, resolve.aliases(n), entities, n, resolve.name_search(entities))


def etl_json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"), F.countDistinct("user_id").alias("n_users"))


def ev_stream_tumbling(spark, sf_dir):
    out = S.tumbling(table(spark, sf_dir, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def ev_stream_sessions(spark, sf_dir):
    out = S.sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("session_start", "session_end")), "n")


QUERIES = {f.__name__: f for f in (
    mem_write_reasons, er_extract, er_link_candidates, er_resolve, mem_scoped, mem_supersede, mem_forget, eval_run_summary, er_clean_mention, er_node_key, vec_store_delete,
    mem_recent_messages, mem_token_estimate, mem_summary, mem_lexical_retrieve, mem_sensitive_filter, mem_upsert, mem_explicit_capture, eval_bool_summary, eval_numeric_summary, eval_keyword_recall,
    eval_match_metrics, eval_count_by_key, er_normalize_mention, er_router_label, er_quoted_mentions, er_proper_mentions, kg_alias_map, kg_alias_first_wins, er_alias_link, er_ground, etl_json_props, ev_stream_tumbling, ev_stream_sessions,
)}

_PLAIN = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_MENTION = f"regexp_replace(regexp_replace(trim(regexp_replace(translate(translate(lower({{}}), '{T.ACCENTED}', '{T.PLAIN}'), '_', ' '), '\\s+', ' ', 'g')), '^[^a-z0-9\\x{{{{80}}}}-\\x{{{{FFFF}}}}]+', ''), '[^a-z0-9\\x{{{{80}}}}-\\x{{{{FFFF}}}}]+$', '')"
_RECENT = "m AS (SELECT conv_id AS session, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS age FROM conversations WHERE trim(text) <> '')"
_PUNCT = "[!-/:-@\\[-`{-~。，！？；：、“”‘’（）《》【】]"
_BARE = "trim(regexp_replace(regexp_replace(" + _PLAIN + ", '" + _PUNCT.replace("{", "{{").replace("'", "''") + "', '', 'g'), '\\s+', ' ', 'g'))"
_CASES = "c AS (SELECT doc_id, text, lang, list_slice(string_split_regex(trim(text), '\\s+'), 1, 5) AS keywords FROM documents JOIN labels USING (doc_id))"
_ALIAS = f"al AS (SELECT DISTINCT node_key, unnest([name, lower(name), node_key, {_MENTION.format('name')}]) AS alias_key FROM nodes)"
_LINK = f"""WITH {EDGES_SQL}, {NODES_SQL}, {_ALIAS}, amap AS (SELECT alias_key, max(node_key) AS node_key FROM al WHERE alias_key <> '' GROUP BY 1),
    ment AS (SELECT n_nationkey AS query_id, lower(translate(n_name, '_', ' ')) AS mention FROM nation),
    t AS (SELECT query_id, mention, 0 AS tier, mention AS alias_key FROM ment UNION ALL SELECT query_id, mention, 1, lower(mention) FROM ment UNION ALL SELECT query_id, mention, 2, {_MENTION.format('mention')} FROM ment),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id, mention ORDER BY tier, node_key) AS r FROM t JOIN amap USING (alias_key)),
    lk AS (SELECT query_id, mention, node_key, CASE WHEN node_key IS NULL THEN 0.0::DOUBLE WHEN tier = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM ment LEFT JOIN (SELECT * FROM h WHERE r = 1) USING (query_id, mention))"""
_SAID = "SELECT n_nationkey AS query_id, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name || ' ' || n_name || ' land' ELSE 'nation of ' || n_name END AS mention FROM nation"


def _hashed(rows, cells):
    """Cells of hashed words of rows (k, t), of unit length."""
    return f"""{rows}_t AS (SELECT k, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) AS w FROM {rows}),
    {rows}_c AS (SELECT k, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS idx, sum(CASE WHEN ('0x' || substr(md5(w), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS s FROM {rows}_t GROUP BY 1, 2),
    {cells} AS (SELECT k, idx, s / sqrt(sum(s * s) OVER (PARTITION BY k)) AS v FROM {rows}_c WHERE s <> 0)"""


_CANDIDATES = f"""{_LINK.replace("SELECT n_nationkey AS query_id, lower(translate(n_name, '_', ' ')) AS mention FROM nation", _SAID)},
    ent AS (SELECT 'nation:' || n_nationkey AS node_key, n_nationkey AS id, n_name AS name FROM nation),
    asked AS (SELECT query_id AS k, mention, ent.id AS own, coalesce(ent.name, mention) AS t FROM lk LEFT JOIN ent USING (node_key)), names AS (SELECT id AS k, name AS t FROM ent),
    {_hashed("asked", "qc")}, {_hashed("names", "ec")}, dots AS (SELECT qc.k AS q, ec.k AS id, sum(qc.v * ec.v) AS c FROM qc JOIN ec USING (idx) GROUP BY 1, 2),
    d AS (SELECT a.k AS q, e.k AS id, round(1 - coalesce(c, 0), 9) AS d FROM asked a CROSS JOIN names e LEFT JOIN dots ON dots.q = a.k AND dots.id = e.k),
    near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS r FROM d QUALIFY r <= 3),
    u AS (SELECT k AS q, own AS id, 1.0::DOUBLE AS score, 'alias_map' AS source, 0 AS r FROM asked WHERE own IS NOT NULL
          UNION ALL SELECT q, id, least(1, greatest(0, 1 - d)), 'vector', r FROM near JOIN asked ON k = q WHERE own IS NULL OR own <> id),
    z AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r, id) AS rank, score - coalesce(lead(score) OVER (PARTITION BY q ORDER BY r, id), 0) AS margin FROM u),
    s AS (SELECT *, rank = 1 AND (source = 'alias_map' OR (round(score, 9) >= 0.72 AND round(margin, 9) >= 0.05)) AS selected FROM z WHERE rank <= 3)"""
_SENS = " OR ".join(f"regexp_matches(text, '{p}')" for p in T.SENSITIVE)
_OUTER = T.OUTER.replace("'", "''")
_CLEAN = f"trim(regexp_replace(coalesce(m, ''), '\\s+', ' ', 'g'), '{_OUTER}')"
for _p in T.PREFIXES:
    _CLEAN = f"trim(regexp_replace({_CLEAN}, '(?i)^{_p}', ''))"
for _p in T.SUFFIXES:
    _CLEAN = f"trim(regexp_replace({_CLEAN}, '(?i){_p}$', ''))"
_NO_ENTITY = ", ".join(f"'{w}'" for w in T.NO_ENTITY)
ORACLES = {
    "mem_write_reasons": f"""WITH c AS (SELECT conv_id AS scope, turn, CASE turn % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'rumour' END AS kind, text FROM conversations),
        p AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY turn, kind, text) AS place FROM c),
        r AS (SELECT scope, CASE WHEN place > 5 THEN 'write_candidate_budget' WHEN scope % 7 = 0 THEN 'missing_user_id' WHEN kind = 'rumour' THEN 'memory_type_not_allowed' WHEN {_SENS} THEN 'sensitive_content'
            WHEN turn % 4 = 0 THEN 'invalid_confidence' ELSE 'written' END AS reason FROM p) SELECT scope, reason, count(*) AS n FROM r GROUP BY 1, 2""",
    "er_extract": """SELECT c_custkey AS query_id, 1 AS rank, c_name AS mention, 10 AS "start", 10 + length(c_name) AS "end", 0.93::DOUBLE AS confidence FROM customer
        UNION ALL SELECT c_custkey, 2, 'Customer', 10, 18, 0.78::DOUBLE FROM customer""",
    "er_link_candidates": f"""{_CANDIDATES} SELECT q AS query_id, mention, rank, 'nation:' || id AS node_key, round(score, 6) AS score, source, selected,
        CASE WHEN max(selected::INT) OVER (PARTITION BY q) = 1 THEN 'selected' ELSE 'need_confirmation' END AS status FROM s JOIN asked ON k = q""",
    "er_resolve": "SELECT n_nationkey AS query_id, n_name AS mention, 'nation:' || n_nationkey AS node_key, 'direct_node_key' AS method, 1.0::DOUBLE AS score, 1 AS rank FROM nation",
    "mem_scoped": """WITH m AS (SELECT conv_id || '-' || turn || '-' || role AS memory_id, conv_id // 4 AS u, CASE WHEN turn % 2 = 0 THEN conv_id END AS s, turn AS t FROM conversations WHERE turn % 5 <> 0),
        a AS (SELECT DISTINCT conv_id AS query_id, conv_id // 4 AS u, CASE WHEN conv_id % 2 = 0 THEN conv_id END AS s FROM conversations)
        SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, memory_id) AS rank FROM a JOIN m ON a.u = m.u AND (a.s IS NULL OR m.s IS NULL OR a.s = m.s)""",
    "mem_supersede": "SELECT conv_id || '-' || turn AS memory_id, conv_id AS scope, CASE WHEN turn >= 3 THEN 'superseded' ELSE 'active' END AS status FROM conversations WHERE role = 'user'",
    "mem_forget": "SELECT conv_id || '-' || turn AS memory_id, conv_id AS scope FROM conversations WHERE role = 'user' AND turn < 3",
    "eval_run_summary": """WITH d AS (SELECT coalesce(toxic = 1, false) AS e, trim(coalesce(text, '')) <> '' AS a, coalesce(quality, 0) > 0 AS v, coalesce(n_chars % 3, 0) > 0 AS g FROM documents JOIN labels USING (doc_id))
        SELECT count(*) AS total, count_if(e) AS num_errors, count_if(a) AS num_with_answer, count_if(v) AS num_with_evidence, count_if(g) AS num_with_grounded_entities, round_even(count_if(e) / count(*), 4) AS errors_rate,
        round_even(count_if(a) / count(*), 4) AS with_answer_rate, round_even(count_if(v) / count(*), 4) AS with_evidence_rate, round_even(count_if(g) / count(*), 4) AS with_grounded_entities_rate FROM d""",
    "er_clean_mention": f"""WITH d AS (SELECT doc_id, array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 1, 3), ' ') AS m FROM documents),
        n AS (SELECT doc_id, m, trim(regexp_replace(coalesce(m, ''), '\\s+', ' ', 'g'), '{_OUTER}') AS n FROM d)
        SELECT doc_id, trim({_CLEAN}, '{_OUTER}') AS mention, n <> '' AND length(n) <= 120 AND (length(n) > 1 OR regexp_matches(n, '^[A-Z]$')) AND NOT regexp_matches(n, '^\\p{{Nd}}+$') AND NOT regexp_matches(n, '^[^\\p{{L}}\\p{{N}}]+$')
        AND trim(lower(n)) NOT IN ({_NO_ENTITY}) AS valid FROM n""",
    "er_node_key": f"WITH {EDGES_SQL}, {NODES_SQL} SELECT node_key, trim(regexp_replace(translate(translate(lower(coalesce(name, '')), '{T.ACCENTED}', '{T.PLAIN}'), '_-', '  '), '\\s+', ' ', 'g')) AS index_key FROM nodes",
    "vec_store_delete": "SELECT vec_id, label FROM embeddings WHERE NOT (vec_id % 4 = 0 AND coalesce(label = 3, false))",
    "mem_recent_messages": f"WITH {_RECENT} SELECT session, turn, role, age FROM m WHERE age <= 5",
    "mem_token_estimate": """SELECT conv_id AS session, turn, role, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(a / 4 + (length(text) - a) / 1.5::DOUBLE))::INT END AS n_tokens
        FROM (SELECT *, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS a FROM conversations)""",
    "mem_summary": f"""WITH {_RECENT}, s AS (SELECT session, string_agg(role || ': ' || rtrim(substr(trim(text), 1, 720)), chr(10) ORDER BY age DESC) AS summary FROM m WHERE age <= 12 GROUP BY session)
        SELECT session, md5(summary) AS summary_md5, length(summary)::INT AS n_chars FROM s""",
    "mem_lexical_retrieve": f"""WITH m AS (SELECT conv_id || '-' || turn AS memory_id, conv_id AS scope, {_PLAIN.format('text')} AS c, make_timestamp((1700000000 + turn * 86400) * 1000000) AS updated_at FROM conversations WHERE role = 'user'),
        w AS (SELECT *, list_distinct(regexp_extract_all(c, '[a-z0-9_]+')) AS b, ['the', 'of', 'and', 'that'] AS a FROM m),
        r AS (SELECT *, round(0.72::DOUBLE * CASE WHEN contains(c, 'the of and that') THEN 1 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END + 0.18::DOUBLE * 0.8::DOUBLE
            + 0.10::DOUBLE * exp(-greatest(0, epoch_us(TIMESTAMP '{AS_OF}' ) - epoch_us(updated_at)) / 86400000000.0::DOUBLE / 180), 9) AS relevance FROM w),
        k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY relevance DESC, updated_at DESC, memory_id) AS rank FROM r)
        SELECT scope, memory_id, round(relevance, 6) AS relevance, rank FROM k WHERE rank <= 3""",
    "mem_sensitive_filter": f"SELECT ({_SENS}) AS sensitive, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "mem_upsert": f"""SELECT conv_id AS scope, 'fact' AS memory_type, md5({_PLAIN.format('text')}) AS key_md5, 0.8::DOUBLE AS confidence, count(*) AS n FROM conversations WHERE role = 'user' AND NOT ({_SENS}) GROUP BY conv_id, {_PLAIN.format('text')}""",
    "mem_explicit_capture": """WITH a AS (SELECT conv_id AS session, turn, trim(regexp_extract(text, '(?i)(?:remember that|please remember|记住|请记住)[:：,， ]*(.{2,500})', 1)) AS content FROM conversations
          WHERE role = 'user' AND regexp_matches(text, '(?i)(?:remember that|please remember|记住|请记住)[:：,， ]*(.{2,500})') AND NOT regexp_matches(text, '(?i)(?:don''t remember|do not remember|不要记住|别记住)'))
        SELECT session, turn, content, CASE WHEN regexp_matches(lower(content), 'prefer|like|喜欢|偏好') THEN 'preference' WHEN regexp_matches(lower(content), 'must|never|always|必须|不要') THEN 'constraint'
          WHEN regexp_matches(lower(content), 'project|项目') THEN 'project' WHEN regexp_matches(lower(content), 'todo|task|任务') THEN 'task' ELSE 'fact' END AS memory_type FROM a""",
    "eval_bool_summary": "SELECT count(quality) AS total, count_if(quality = 1) AS passed, round_even(count_if(quality = 1) / count(quality), 4) AS rate FROM labels",
    "eval_numeric_summary": "SELECT count(n_chars) AS count, round_even(avg(n_chars), 4) AS avg, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, round_even(quantile_cont(n_chars, 0.5), 4) AS p50, round_even(quantile_cont(n_chars, 0.9), 4) AS p90, round_even(quantile_cont(n_chars, 0.95), 4) AS p95 FROM documents",
    "eval_keyword_recall": f"WITH {_CASES} SELECT doc_id, round(len(list_filter(keywords, lambda k: contains({_PLAIN.format('text')}, {_PLAIN.format('k')})))::DOUBLE / len(keywords), 6) AS recall FROM c",
    "eval_match_metrics": f"WITH {_CASES}, r AS (SELECT doc_id, {_BARE.format('text')} AS a, {_BARE.format(chr(97) + 'rray_to_string(keywords, ' + chr(39) + ' ' + chr(39) + ')')} AS b, array_to_string(keywords, ' ') AS ref FROM c) SELECT doc_id, CASE WHEN trim(ref) = '' THEN NULL ELSE a = b END AS exact, CASE WHEN trim(ref) = '' THEN NULL ELSE contains(a, b) END AS contained FROM r",
    "eval_count_by_key": "SELECT coalesce(lang, '') AS key, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "er_normalize_mention": f"SELECT n_nationkey, {_MENTION.format('n_name')} AS mention FROM nation",
    "er_router_label": "SELECT item_id, CASE WHEN length(trim(text)) <= 1 THEN 'clarify' WHEN regexp_matches(lower(text), '\\bpython\\b|\\bjava\\b|c\\+\\+|\\bbug\\b|cover\\s*letter') THEN 'direct_llm' WHEN regexp_matches(lower(text), '\\b(?:relation|path|neighbor|triple|connected|related)\\b|\\bwho\\s+is\\b|\\bwhich\\b.*\\b(?:related|connected|belongs)\\b') OR len(regexp_extract_all(trim(text), '\\b([A-Z][A-Za-z0-9_.-]*)\\b')) >= 2 THEN 'kg_rag' ELSE 'direct_llm' END AS route FROM benchmark",
    "er_quoted_mentions": "WITH q AS (SELECT doc_id, list_filter(list_transform(list_concat(regexp_extract_all(text, '\"([^\"\\n]{1,80})\"', 1), regexp_extract_all(text, '“([^”\\n]{1,80})”', 1), regexp_extract_all(text, '「([^」\\n]{1,80})」', 1), regexp_extract_all(text, '『([^』\\n]{1,80})』', 1), regexp_extract_all(text, '《([^》\\n]{1,80})》', 1)), lambda x: trim(x)), lambda x: x <> '') AS m FROM documents) SELECT doc_id, (unnest(range(1, len(m) + 1)) - 1)::INT AS pos, unnest(m) AS mention FROM q WHERE len(m) > 0",
    "er_proper_mentions": "WITH q AS (SELECT item_id, regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_]*[^\\x00-\\x7F][\\p{L}A-Za-z0-9_]*', 'é', 'g'), '\\b([A-Z][A-Za-z0-9_.-]*(?: [A-Z][A-Za-z0-9_.-]*)*)\\b', 1) AS m FROM benchmark) SELECT item_id, (unnest(range(1, len(m) + 1)) - 1)::INT AS pos, unnest(m) AS mention FROM q WHERE len(m) > 0",
    "kg_alias_map": f"WITH {EDGES_SQL}, {NODES_SQL}, {_ALIAS} SELECT alias_key, max(node_key) AS node_key FROM al WHERE alias_key <> '' GROUP BY 1",
    "kg_alias_first_wins": f"WITH {EDGES_SQL}, {NODES_SQL}, {_ALIAS} SELECT alias_key, min(node_key) AS node_key FROM al WHERE alias_key <> '' GROUP BY 1",
    "er_alias_link": f"{_LINK} SELECT * FROM lk",
    "er_ground": f"""{_LINK}, g AS (SELECT query_id, node_key, max(confidence) AS confidence, min(mention) AS mention FROM lk WHERE node_key IN (SELECT node_key FROM nodes) GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, node_key) AS rank FROM g""",
    "etl_json_props": "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS sum_k, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
    "ev_stream_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "ev_stream_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""",
}
