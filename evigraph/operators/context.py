"""What a question is answered with from memory: summaries, memories and recent messages, packed into budgets of tokens.

Packing is a running sum over a group's segments, so texts beyond a budget are never put together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import memory as M

CONTEXT_TOKENS, SUMMARY_TOKENS, MESSAGE_TOKENS = 4000, 1200, 180
MOST_MEMORIES, LEAST_SCORE = 8, 0.15
# Headings of the sections of a context and of a summary, names of roles in a summary, names of nobody and no project.
SUMMARY_HEAD, MEMORY_HEAD, RECENT_HEAD = "[会话摘要]", "[相关长期记忆]", "[最近对话]"
BEFORE_HEAD, POINTS_HEAD = "已有上下文：", "最近对话要点："
ROLES = {"user": "用户", "assistant": "助手"}
ANONYMOUS, DEFAULT_PROJECT = "__anonymous__", "__default__"


def session_key(user: Column, project: Column, session: Column) -> Column:
    """One key of user, project and session; lengths keep parts apart. Null for a blank session."""
    parts = [F.coalesce(F.nullif(T.strip(c.cast("string")), F.lit("")), F.lit(d)) for c, d in ((user, ANONYMOUS), (project, DEFAULT_PROJECT), (session, ""))]
    key = F.concat_ws("|", *(F.concat(F.length(p), F.lit(":"), p) for p in parts))
    return F.when(parts[2] != "", key)


def pack(segments: DataFrame, group: str, order: Sequence[str], budget: int) -> DataFrame:
    """group, text, estimated_tokens: each group's segments (column text) joined in order, as far as budget goes.

    The segment that crosses the budget is cut between two characters, later ones are left out, and
    a cut text loses white space at its end. Estimates are never above the budget; with a budget of
    0 or less all texts are empty. Only segments that are kept are brought together, and these have
    at most 4 * budget + 3 characters in all. Null segments are empty; ties of order go by the text.
    """
    body = F.coalesce("text", F.lit(""))
    rows = segments.select(group, *order, body.alias("text")).withColumn("_a", T.ascii_count(F.col("text"))).withColumn("_o", F.length("text") - F.col("_a"))
    before = Window.partitionBy(group).orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order, "text")))
    for c in ("_a", "_o"):
        rows = rows.withColumn(f"{c}0", F.coalesce(F.sum(c).over(before), F.lit(0)))
    spent = lambda a, o: F.floor(a / 4 + o / 1.5)
    whole = spent(F.col("_a0") + F.col("_a"), F.col("_o0") + F.col("_o")) <= budget
    reached = rows.filter(spent(F.col("_a0"), F.col("_o0")) <= budget).withColumn("_whole", whole)
    part = F.when(F.col("_whole"), F.col("text")).otherwise(T.prefix_tokens(F.col("text"), max(0, budget), F.col("_a0"), F.col("_o0")))
    kept = reached.withColumn("text", part if budget > 0 else F.lit(""))
    # a group keeps one empty segment at least, so that it has a row
    kept = kept.filter((F.col("text") != "") | ~F.col("_whole") | (F.col("_at") == 1))
    joined = kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_s"), F.every("_whole").alias("_all"))
    text = F.array_join(F.transform("_s", lambda x: x["text"]), "")
    out = joined.select(group, F.when(F.col("_all"), text).otherwise(T.rstrip(text)).alias("text"))
    return out.withColumn("estimated_tokens", T.estimate_tokens(F.col("text")))


def summarize(messages: DataFrame, previous: DataFrame | None = None, budget: int = SUMMARY_TOKENS) -> DataFrame:
    """session, summary, estimated_tokens: the summary so far (session, summary), then the last messages (session, turn, role, text).

    A message is cut to MESSAGE_TOKENS, the whole to budget. A session without messages keeps its
    summary, cut to budget; blank messages and a blank or null summary don't count.
    """
    last = M.recent_messages(messages.withColumn("text", T.strip(F.col("text"))), M.SUMMARY_MESSAGES)
    role = F.coalesce(T.strip(F.col("role")), F.lit(""))
    for name, said in ROLES.items():
        role = F.when(F.col("role") == name, said).otherwise(role)
    points = last.select("session", F.lit(2).alias("section"), (-F.col("age")).alias("ord"), F.concat(F.lit("\n- "), role, F.lit(": "), T.trim_tokens(F.col("text"), MESSAGE_TOKENS)).alias("text"))
    active = last.select("session").distinct()
    segments = active.select("session", F.lit(1).alias("section"), F.lit(0).alias("ord"), F.lit(POINTS_HEAD).alias("text")).unionByName(points)
    if previous is not None:
        held = previous.select("session", F.coalesce("summary", F.lit("")).alias("summary"))
        told = held.join(active.withColumn("_talks", F.lit(True)), "session", "left")
        said = T.strip(F.col("summary"))
        with_head = F.when(said != "", F.concat(F.lit(BEFORE_HEAD + "\n"), said, F.lit("\n"))).otherwise("")
        segments = segments.unionByName(told.select("session", F.lit(0).alias("section"), F.lit(0).alias("ord"), F.when(F.col("_talks"), with_head).otherwise(F.col("summary")).alias("text")))
    return pack(segments, "session", ["section", "ord"], budget).withColumnRenamed("text", "summary")


def _words(low: Column) -> Column:
    """Different words (letters, digits and _ of any script) of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def _relevance(q: Column, q_words: Column, c: Column, c_words: Column, confidence: Column, updated_at: Column, as_of: Column) -> Column:
    both = F.size(F.array_intersect(q_words, c_words))
    overlap = both / F.greatest(F.size(q_words) + F.size(c_words) - both, F.lit(1))
    lexical = F.when(q == "", 0.35).when(F.contains(c, q) | F.contains(q, c), 1.0).otherwise(overlap)
    days = (F.unix_micros(as_of) - F.unix_micros(F.try_to_timestamp(updated_at.cast("string")))) / 86_400_000_000
    recency = F.when(days.isNull(), 0.0).otherwise(F.exp(-F.greatest(F.lit(0.0), days) / 180))
    return T.clip(0.72 * lexical + 0.18 * T.clip(confidence) + 0.10 * recency)


def _asked(query: Column) -> Column:
    return F.lower(T.strip(query))


def _said(content: Column) -> Column:
    return F.lower(F.coalesce(content, F.lit("")))


def relevance(query: Column, content: Column, confidence: Column, updated_at: Column, as_of: Column) -> Column:
    """0.72 lexical, 0.18 confidence, 0.10 recency, in [0, 1].

    Lexical: 0.35 for an empty query, 1 if one text holds the other, else the Jaccard similarity of
    their words (letters, digits and _ of any script). A time that can't be read counts as none.
    """
    q, c = _asked(query), _said(content)
    return _relevance(q, _words(q), c, _words(c), confidence, updated_at, as_of)


def retrieve_for(requests: DataFrame, memories: DataFrame, as_of: str, k: int = MOST_MEMORIES, least: float = LEAST_SCORE, types: Sequence[str] = ()) -> DataFrame:
    """query_id, the columns of memories, score, rank: the best k memories that each request may see.

    requests: query_id, query, namespace, user_id, project_id, session_id, one row a question. A
    request meets the memories of its own scope only (memory.scoped). Ties go to the newer memory,
    then to the smaller id. With types, other kinds of memories are not looked at. Words are taken
    from each memory and each question once, not once a pair.
    """
    able = memories.filter(F.col("memory_type").isin(*types)) if types else memories
    able = able.withColumn("_c", _said(F.col("content"))).withColumn("_cw", _words(F.col("_c")))
    told = requests.select("query_id", _asked(F.col("query")).alias("_q")).withColumn("_qw", _words(F.col("_q")))
    seen = M.scoped(able, requests, as_of).drop("rank").join(told, "query_id")
    score = _relevance(F.col("_q"), F.col("_qw"), F.col("_c"), F.col("_cw"), F.col("confidence"), F.col("updated_at"), F.lit(as_of).cast("timestamp"))
    scored = seen.withColumn("score", F.round(score, 9)).filter(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("updated_at"), "memory_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", *memories.columns, "score", "rank")


def assemble(requests: DataFrame, messages: DataFrame, summaries: DataFrame, found: DataFrame, budget: int = CONTEXT_TOKENS, keep: int = M.MAX_MESSAGES) -> DataFrame:
    """query_id, text, estimated_tokens, n_memories, n_recent: the memory context of every request.

    requests: query_id, session (see session_key; null has neither summary nor messages); messages:
    session, turn, role, text; summaries: session, summary; found: query_id, memory_type, score,
    content, rank (see retrieve_for). Sections come in this order, each only if it has anything:
    the summary, the memories, the last ``keep`` messages. The whole is cut to budget.
    """
    asked = requests.select("query_id", "session")
    head = lambda df, section, text: df.select("query_id", F.lit(section).alias("section"), F.lit(0).alias("ord"), text.alias("text"))
    said = asked.join(summaries.select("session", T.strip(F.col("summary")).alias("summary")), "session").filter("summary <> ''")
    number = F.format_string("%.3f", F.col("score"))
    lines = found.select("query_id", F.lit(1).alias("section"), F.col("rank").alias("ord"), F.concat(F.lit("\n- ("), F.col("memory_type"), F.lit(", "), number, F.lit(") "), F.coalesce("content", F.lit(""))).alias("text"))
    last = M.recent_messages(messages.withColumn("text", T.strip(F.col("text"))), keep)
    role = F.coalesce(F.nullif(T.strip(F.col("role")), F.lit("")), F.lit("unknown"))
    talk = asked.join(last, "session").select("query_id", F.lit(2).alias("section"), (keep + 1 - F.col("age")).alias("ord"), F.concat(F.lit("\n- "), role, F.lit(": "), F.col("text")).alias("text"))
    heads = head(said, 0, F.concat(F.lit(SUMMARY_HEAD + "\n"), F.col("summary"))).unionByName(head(lines.select("query_id").distinct(), 1, F.lit(MEMORY_HEAD))).unionByName(head(talk.select("query_id").distinct(), 2, F.lit(RECENT_HEAD)))
    parts = heads.unionByName(lines).unionByName(talk)
    first = F.min("section").over(Window.partitionBy("query_id"))
    parts = parts.withColumn("_first", first).withColumn("text", F.when((F.col("ord") == 0) & (F.col("section") > F.col("_first")), F.concat(F.lit("\n\n"), "text")).otherwise(F.col("text")))
    counts = parts.filter("ord > 0").groupBy("query_id").agg(F.count_if(F.col("section") == 1).alias("n_memories"), F.count_if(F.col("section") == 2).alias("n_recent"))
    packed = pack(parts, "query_id", ["section", "ord"], budget)
    out = asked.select("query_id").join(packed, "query_id", "left").join(counts, "query_id", "left")
    return out.select("query_id", F.coalesce("text", F.lit("")).alias("text"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("estimated_tokens", "n_memories", "n_recent")))


def load(requests: DataFrame, messages: DataFrame, summaries: DataFrame, memories: DataFrame, as_of: str, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """assemble() with the memories that retrieve_for() finds; requests have the columns of both."""
    return assemble(requests, messages, summaries, retrieve_for(requests, memories, as_of), budget)
