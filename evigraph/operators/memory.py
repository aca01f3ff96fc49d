"""Conversation memory in batches: recent messages, summaries, retrieval, policy and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T

MAX_MESSAGES, SUMMARY_MESSAGES, SUMMARY_CHARS = 20, 12, 720
#: Candidates that one write takes.
MOST_CANDIDATES = 8
# Kinds of memories.
MEMORY_TYPES = ("preference", "fact", "constraint", "project", "task", "summary", "note")
# How a message asks to be remembered, and its negations.
EXPLICIT = r"(?i)(?:remember that|please remember|记住|请记住)[:：,， ]*(.{2,500})"
NEGATED = r"(?i)(?:don't remember|do not remember|不要记住|别记住)"


def recent_messages(messages: DataFrame, keep: int = MAX_MESSAGES) -> DataFrame:
    """The last messages (session, turn, role, text) of every session, blank ones dropped; column age, 1 for the newest."""
    order = Window.partitionBy("session").orderBy(F.desc("turn"), F.desc("text"))
    return messages.filter("trim(text) <> ''").withColumn("age", F.row_number().over(order)).filter(F.col("age") <= keep)


def summarize(messages: DataFrame) -> DataFrame:
    """session, summary: the last SUMMARY_MESSAGES messages in order, one a line, each cut to SUMMARY_CHARS characters."""
    last = recent_messages(messages, SUMMARY_MESSAGES)
    line = F.concat(F.col("role"), F.lit(": "), F.rtrim(F.substring(F.trim("text"), 1, SUMMARY_CHARS)))
    rows = last.groupBy("session").agg(F.sort_array(F.collect_list(F.struct((-F.col("age")).alias("o"), line.alias("line")))).alias("ls"))
    return rows.select("session", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("summary"))


def lexical(query: Column, content: Column) -> Column:
    """0.35 for an empty query, 1 if the content holds it, else the Jaccard similarity of their words."""
    q, c = T.plain(query), T.plain(content)
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("([a-z0-9_]+)"), F.lit(1)))
    a, b = words(q), words(c)
    union = F.size(F.array_union(a, b))
    return F.when(q == "", 0.35).when(F.contains(c, q), 1.0).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def retrieve(memories: DataFrame, query: str, as_of: str, k: int = 8, min_relevance: float = 0.0) -> DataFrame:
    """memories with relevance, best k of each scope: 0.72 lexical, 0.18 confidence, 0.10 recency at the time as_of."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 86_400_000_000)
    total = 0.72 * lexical(F.lit(query), F.col("content")) + 0.18 * T.clip(F.col("confidence")) + 0.10 * F.exp(-age / 180)
    order = Window.partitionBy("scope").orderBy(F.desc("relevance"), F.desc("updated_at"), "memory_id")
    out = memories.withColumn("relevance", F.round(total, 9)).filter(F.col("relevance") >= min_relevance)
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def active(memories: DataFrame, as_of: str) -> DataFrame:
    """Active rows without an expiry or with one after as_of; an expiry that can't be read makes a row inactive."""
    expiry = F.try_to_timestamp(F.col("expires_at"))
    return memories.filter((F.col("status") == "active") & (F.col("expires_at").isNull() | F.coalesce(expiry > F.lit(as_of).cast("timestamp"), F.lit(False))))


def upsert(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """scope, memory_type, key, content, confidence, n: rows with one scope, type and normalised content are one, with the best confidence.

    Contents that hold secrets are not written.
    """
    clean = candidates.filter(~T.sensitive(F.col("content"))).select("scope", "memory_type", "content", "confidence")
    both = existing.select("scope", "memory_type", "content", "confidence").unionByName(clean).withColumn("key", T.plain(F.col("content")))
    return both.groupBy("scope", "memory_type", "key").agg(F.min("content").alias("content"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))


def explicit_capture(messages: DataFrame) -> DataFrame:
    """What users ask to remember: session, turn, content, memory_type; negated requests are ignored."""
    asked = messages.filter((F.col("role") == "user") & F.col("text").rlike(EXPLICIT) & ~F.col("text").rlike(NEGATED))
    content = F.trim(F.regexp_extract("text", EXPLICIT, 1))
    low = F.lower(content)
    kind = F.when(low.rlike("prefer|like|喜欢|偏好"), "preference").when(low.rlike("must|never|always|必须|不要"), "constraint").when(low.rlike("project|项目"), "project").when(low.rlike("todo|task|任务"), "task").otherwise("fact")
    return asked.select("session", "turn", content.alias("content"), kind.alias("memory_type"))


def scoped(memories: DataFrame, scopes: DataFrame, as_of: str) -> DataFrame:
    """Active memories that each scope may see, newest first: the columns of memories besides query_id and rank.

    scopes is (query_id, namespace, user_id, project_id, session_id); a null or blank user, project or
    session asks for any. The namespace must be equal, and null names none. A memory of a session is
    seen from that session or where no session is asked for; one without a session from everywhere.
    Scopes that name a user meet that user's rows only, so a large namespace is no hot key for them.
    """
    asked = scopes.select("query_id", *(F.nullif(F.trim(c), F.lit("")).alias(f"_{c}") for c in ("namespace", "user_id", "project_id", "session_id")))
    live = active(memories, as_of)
    sees = (
        (F.col("_project_id").isNull() | F.col("project_id").eqNullSafe(F.col("_project_id")))
        & (F.col("_session_id").isNull() | (F.coalesce("session_id", F.lit("")) == "") | (F.col("session_id") == F.col("_session_id")))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("updated_at"), "memory_id")
    space = F.col("namespace") == F.col("_namespace")
    of_user = asked.filter("_user_id is not null").join(live, space & (F.col("user_id") == F.col("_user_id")) & sees)
    of_any = asked.filter("_user_id is null").join(live, space & sees)
    return of_user.unionByName(of_any).select("query_id", *memories.columns, F.row_number().over(order).alias("rank"))


def supersede(memories: DataFrame, ids: DataFrame, status: str = "superseded") -> DataFrame:
    """memories, those named in ids (memory_id) with the given status; ids of no memory do nothing."""
    named = ids.select("memory_id").distinct().withColumn("_named", F.lit(True))
    return memories.join(named, "memory_id", "left").withColumn("status", F.when(F.col("_named"), F.lit(status)).otherwise(F.col("status"))).select(memories.columns)


def forget(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """memories without those named in ids (memory_id)."""
    return memories.join(ids.select("memory_id"), "memory_id", "left_anti").select(memories.columns)


def unwritten(turns: DataFrame, written: DataFrame, key: str = "request_id") -> DataFrame:
    """Turns whose key is not among those written, each key once; a turn without a key is always new."""
    new = turns.join(written.select(key), key, "left_anti").select(turns.columns)
    return new.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(new.filter(F.col(key).isNull()))


def screen(candidates: DataFrame, most: int = MOST_CANDIDATES, need_user: bool = True, types: tuple[str, ...] = MEMORY_TYPES) -> DataFrame:
    """candidates (scope, ord, user_id, memory_type, content, confidence) with reason: why a row is not written, null for those that are.

    The first reason that holds counts: beyond the first most of a scope (by ord, then type and
    content), no user, a type that is not allowed or null, a secret in the content, a confidence
    that is not positive or null.
    """
    place = F.row_number().over(Window.partitionBy("scope").orderBy("ord", "memory_type", "content"))
    no_user = (F.trim(F.coalesce(F.col("user_id").cast("string"), F.lit(""))) == "") if need_user else F.lit(False)
    reason = (
        F.when(F.col("_place") > most, "write_candidate_budget")
        .when(no_user, "missing_user_id")
        .when(~F.coalesce(F.col("memory_type").isin(*types), F.lit(False)), "memory_type_not_allowed")
        .when(T.sensitive(F.col("content")), "sensitive_content")
        .when(~(F.coalesce(F.col("confidence"), F.lit(0.0)) > 0), "invalid_confidence")
    )
    return candidates.withColumn("_place", place).withColumn("reason", reason).drop("_place")
