"""Evidence: from search results to scored, selected and cited rows.

An evidence row has query_id, evidence_type, source_entity, relation, target_entity, path
(array<string>), triples (array<struct<head,relation,tail>>), score, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import search

# Order of types in fusion, weight of types in scoring, order of types in reasoning.
FUSION_ORDER = {"relation": 5, "path": 4, "subgraph": 3, "neighbor": 2, "text": 1}
TYPE_SCORE = {"relation": 1.0, "path": 0.78, "neighbor": 0.58, "subgraph": 0.50, "text": 0.45}
REASON_ORDER = {"relation": 4, "path": 3, "neighbor": 2, "subgraph": 1}
RELATION_WORDS = ("关系", "联系", "相关", "连接", "between", "relation", "relationship", "related", "connect")
PATH_WORDS = ("路径", "怎么到", "如何连接", "path", "route")
CLASS_WORDS = ("属于", "类别", "类型", "class", "type", "belong")
CLASS_RELATIONS = ("type", "class", "instance_of", "subclass_of", "belongs_to", "属于")
MAX_EVIDENCE, MAX_SELECTED, MIN_SELECTED, ANSWERABLE, UNCERTAIN = 30, 8, 0.15, 0.55, 0.25


def _map(values: dict, key: str, other) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(key) == k, v).otherwise(out)
    return out


def _triple(head: str, relation: str, tail: str) -> Column:
    return F.struct(F.col(head).alias("head"), F.col(relation).alias("relation"), F.col(tail).alias("tail"))


def from_relations(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.lit("relation").alias("evidence_type"), F.col("head").alias("source_entity"), "relation", F.col("tail").alias("target_entity"), F.array().cast("array<string>").alias("path"), F.array(_triple("head", "relation", "tail")).alias("triples"), T.clip(F.coalesce("score", F.lit(0.9))).alias("score"), "text")


def from_neighbors(found: DataFrame) -> DataFrame:
    return found.filter("target <> ''").select("query_id", F.lit("neighbor").alias("evidence_type"), F.col("source").alias("source_entity"), "relation", F.col("target").alias("target_entity"), F.array().cast("array<string>").alias("path"), F.array(_triple("source", "relation", "target")).alias("triples"), T.clip(F.coalesce("score", F.lit(0.65))).alias("score"), "text")


def from_paths(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Each hop takes the relation of its first edge, looked up among the edges of the hops alone; related_to where the graph has none in that direction."""
    hop = found.select("query_id", "source", "target", "rank", "score", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.struct(F.element_at("path", i).alias("u"), F.try_element_at("path", i + 1).alias("v")))).alias("at", "h"))
    steps, n = search.settle(hop.select(F.col("h.u").alias("_u"), F.col("h.v").alias("_v")).distinct(), "steps")
    used = edges.join(search.hinted(steps, n), (F.col("src") == F.col("_u")) & (F.col("dst") == F.col("_v")), "left_semi")
    first = used.groupBy("src", "dst").agg(F.min_by("relation", F.struct("ord", "relation")).alias("relation"))
    named = hop.join(first, (F.col("h.u") == F.col("src")) & (F.col("h.v") == F.col("dst")), "left")
    triple = F.struct("at", F.struct(F.col("h.u").alias("head"), F.coalesce("relation", F.lit("related_to")).alias("relation"), F.col("h.v").alias("tail")).alias("t"))
    out = named.groupBy("query_id", "source", "target", "rank", "score", "path").agg(F.array_sort(F.collect_list(triple)).alias("ts"))
    triples = F.filter(F.transform("ts", lambda x: x["t"]), lambda t: t["tail"].isNotNull())
    text = F.concat(F.element_at("path", 1), F.array_join(F.transform("triples", lambda t: F.concat(F.lit(" --"), t["relation"], F.lit("--> "), t["tail"])), ""))
    return out.withColumn("triples", triples).select("query_id", F.lit("path").alias("evidence_type"), F.element_at("path", 1).alias("source_entity"), F.lit("path").alias("relation"), F.element_at("path", -1).alias("target_entity"), "path", "triples", T.clip(F.col("score")).alias("score"), text.alias("text"))


def from_subgraph(found: DataFrame) -> DataFrame:
    """Subgraph edges carry no score, so it is always 0.6."""
    return found.select("query_id", F.lit("subgraph").alias("evidence_type"), F.col("head").alias("source_entity"), "relation", F.col("tail").alias("target_entity"), F.array().cast("array<string>").alias("path"), F.array(_triple("head", "relation", "tail")).alias("triples"), F.lit(0.6).alias("score"), search.edge_text("head", "relation", "tail").alias("text"))


def dedup_key() -> Column:
    """What makes two rows of evidence equal: type, source, relation and target, else the path, else the text; empty without any."""
    source, relation, target, text = (T.light(F.col(c)) for c in ("source_entity", "relation", "target_entity", "text"))
    kind = F.concat(F.coalesce(F.nullif(T.light(F.col("evidence_type")), F.lit("")), F.lit("text")), F.lit("::"))
    named = F.concat(source, relation, target) != ""
    nodes = F.array_join(F.transform("path", T.light), "|")
    return (
        F.when(named, F.concat(kind, F.concat_ws("|", source, relation, target)))
        .when(F.size("path") > 0, F.concat(kind, nodes))
        .when(text != "", F.concat(F.lit("text::"), text))
        .otherwise("")
    )


def evidence_id() -> Column:
    """ev_ and twelve hex digits that depend on type, ends, relation, path and text only; null counts as empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("evidence_type", "source_entity", "relation", "target_entity")]
    path = F.array_join(F.coalesce("path", F.array().cast("array<string>")), "\u0002", "")
    whole = F.concat_ws("\u0001", *parts, path, F.coalesce("text", F.lit("")))
    return F.concat(F.lit("ev_"), F.substring(F.md5(whole), 1, 12))


def fuse(evidence: DataFrame, max_evidence: int = MAX_EVIDENCE, min_score: float = 0.0) -> DataFrame:
    """Equal evidence (by dedup_key) once, by best score; by type, then score; at most max_evidence a query; column rank.

    Evidence that names nothing (the empty key) is left out.
    """
    once = Window.partitionBy("query_id", "_key").orderBy(F.desc("score"), "text")
    cut = Window.partitionBy("query_id").orderBy(F.desc("_o"), F.desc("score"), "source_entity", "relation", "target_entity")
    named = evidence.filter(F.col("score") >= min_score).withColumn("_key", dedup_key()).filter("_key <> ''")
    # dealt by query once, for both windows and for what joins queries later
    out = search.dealt(named, "query_id").withColumn("_r", F.row_number().over(once)).filter("_r = 1")
    out = out.withColumn("_o", _map(FUSION_ORDER, "evidence_type", 0)).withColumn("rank", F.row_number().over(cut))
    return out.filter(F.col("rank") <= max_evidence).drop("_key", "_r", "_o")


def retrieve(edges: DataFrame, queries: DataFrame, max_neighbors: int = 10, max_nodes: int = 4, subgraph_nodes: int = 0) -> DataFrame:
    """Fused evidence for every query (query_id, entities array): relations and paths of all pairs, neighbours of each entity.

    Neighbours are searched once for each distinct entity, however many queries name it. With
    subgraph_nodes over 0, the edges of a subgraph of so many nodes around all entities count too,
    cut to MAX_EVIDENCE before the whole is; the other searches find fewer than that by themselves.
    """
    named, _ = search.settle(queries.select("query_id", F.posexplode("entities").alias("at", "entity")), "named")
    a, b = named.select("query_id", F.col("at").alias("i"), F.col("entity").alias("source")), named.select("query_id", F.col("at").alias("j"), F.col("entity").alias("target"))
    pairs = a.join(b, "query_id").filter("i < j and lower(source) <> lower(target)").select("query_id", "source", "target").distinct()
    pairs, _ = search.settle(pairs, "pairs")
    ends, n = search.settle(named.select(F.col("entity").alias("node")).distinct(), "entities")
    # edges out of the entities are looked for once, for relations, neighbours, first hops and their relations
    edges = edges.select("src", "relation", "dst", "score", "ord")
    outs, _ = search.settle(search.within(edges, "src", ends, n), "outs")
    between, _ = search.settle(search.within(outs, "dst", ends, n), "between")
    relations = from_relations(search.relation_search(between, pairs))
    found, _ = search.settle(search.path_search(edges, pairs, max_nodes=max_nodes, outs=outs), "paths")
    inner, m = search.settle(found.select(F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("node")).distinct(), "inner")
    paths = from_paths(found, outs.unionByName(search.within(edges, "src", inner, m)) if m else outs)
    around = search.neighbor_search(edges, named.select(F.col("entity").alias("query_id"), "entity").distinct(), "both", max_neighbors, outs=outs).drop("query_id", "rank")
    neighbors = from_neighbors(named.select("query_id", "entity").distinct().join(around, "entity"))
    found = relations.unionByName(paths).unionByName(neighbors)
    if subgraph_nodes > 0:
        around = search.subgraph_search(edges, named.select("query_id", "entity").distinct(), max_nodes=subgraph_nodes)[1]
        found = found.unionByName(fuse(from_subgraph(around)).drop("rank"))
    return fuse(found)


def _names() -> Column:
    """All names in a row of evidence, compared lightly."""
    parts = F.concat(F.array("source_entity", "target_entity", "relation"), "path", F.flatten(F.transform("triples", lambda t: F.array(t["head"], t["relation"], t["tail"]))))
    return F.filter(F.transform(parts, T.light), lambda x: x != "")


def _entity_overlap(names: Column, light: Column) -> Column:
    hits = F.size(F.filter(names, lambda x: F.contains(light, x) | F.contains(x, light)))
    return F.when(F.size(names) == 0, 0.0).otherwise(hits / F.size(names))


def _relation_match() -> Column:
    rel, kind = F.lower(F.coalesce("relation", F.lit(""))), F.col("evidence_type")
    return (
        F.when(F.col("_relation") & (kind == "relation"), 1.0)
        .when(F.col("_relation") & rel.isin("related_to", "relation"), 0.8)
        .when(F.col("_route") & (kind == "path"), 1.0)
        .when(F.col("_class") & rel.isin(*CLASS_RELATIONS), 1.0)
        .when((rel != "") & F.contains("_lower", rel), 1.0)
        .otherwise(0.4)
    )


def score_evidence(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """evidence with semantic_score against its query (query_id, query), at nine digits.

    What a query alone tells is computed before it meets its evidence, and what several terms use is a column of its own.
    """
    one_of = lambda words: F.greatest(*(F.contains(F.lower("query"), F.lit(w)) for w in words))
    told = {"_lower": F.lower("query"), "_light": T.light(F.col("query")), "_asked": T.evidence_tokens(F.col("query")), "_relation": one_of(RELATION_WORDS), "_route": one_of(PATH_WORDS), "_class": one_of(CLASS_WORDS)}
    out = evidence.join(queries.select("query_id", *(c.alias(n) for n, c in told.items())), "query_id").withColumns({"_named": _names(), "_told": T.evidence_tokens(F.col("text"))})
    total = 0.35 * T.clip(F.col("score")) + 0.20 * _map(TYPE_SCORE, "evidence_type", 0.40) + 0.25 * T.token_overlap(F.col("_asked"), F.col("_told")) + 0.15 * _entity_overlap(F.col("_named"), F.col("_light")) + 0.05 * _relation_match()
    return out.withColumn("semantic_score", F.round(T.clip(total), 9)).drop(*told, "_named", "_told")


def select_evidence(scored: DataFrame) -> DataFrame:
    """scored with sel_rank (order by semantic score) and selected: the first MAX_SELECTED of at least MIN_SELECTED."""
    order = Window.partitionBy("query_id").orderBy(F.desc("semantic_score"), "rank")
    out = scored.withColumn("sel_rank", F.row_number().over(order))
    return out.withColumn("selected", (F.col("semantic_score") >= MIN_SELECTED) & (F.col("sel_rank") <= MAX_SELECTED))


def answerability(queries: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, n_selected, semantic (mean of the five best, weighted by 1 / rank), answerability; queries without evidence too."""
    s = selected.filter("selected").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_selected"),
        (F.sum(F.when(F.col("sel_rank") <= 5, F.col("semantic_score") / F.col("sel_rank"))) / F.sum(F.when(F.col("sel_rank") <= 5, 1 / F.col("sel_rank")))).alias("semantic"),
    )
    out = queries.select("query_id").join(s, "query_id", "left").select("query_id", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), F.round(F.coalesce("semantic", F.lit(0.0)), 9).alias("semantic"))
    verdict = F.when(F.col("n_selected") == 0, "unanswerable").when(F.col("semantic") >= ANSWERABLE, "answerable").when(F.col("semantic") >= UNCERTAIN, "uncertain").otherwise("unanswerable")
    return out.withColumn("answerability", verdict)


def reasoning(selected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """query_id, n_steps, confidence from the five selected rows that reasoning prefers."""
    order = Window.partitionBy("query_id").orderBy(F.desc("_o"), F.desc("semantic_score"), "rank")
    five = selected.filter("selected").withColumn("_o", _map(REASON_ORDER, "evidence_type", 0)).withColumn("_r", F.row_number().over(order)).filter("_r <= 5")
    s = five.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.avg("semantic_score").alias("mean"),
        F.max((F.col("evidence_type") == "relation").cast("int")).alias("rel"),
        F.max((F.col("evidence_type") == "path").cast("int")).alias("pat"),
    )
    out = verdicts.join(s, "query_id", "left").fillna({"n_steps": 0, "mean": 0.0, "rel": 0, "pat": 0})
    bonus = F.when(F.col("answerability") == "answerable", 0.12).when(F.col("answerability") == "uncertain", 0.02).otherwise(-0.20)
    total = 0.45 * F.col("mean") + 0.40 * F.col("semantic") + 0.12 * F.col("rel") + 0.06 * F.col("pat") + bonus
    return out.select("query_id", "n_steps", "answerability", T.clip(total).alias("confidence"))


def citations(selected: DataFrame) -> DataFrame:
    """query_id, citation (E1, E2, ... in order), text of the selected rows."""
    return selected.filter("selected").select("query_id", F.concat(F.lit("E"), F.col("sel_rank").cast("string")).alias("citation"), "evidence_type", "text")


def evidence_text(selected: DataFrame) -> DataFrame:
    """query_id, block: one line for each selected row."""
    line = F.format_string("[E%d] (%s, score=%.3f) %s", F.col("sel_rank"), F.col("evidence_type"), F.col("score"), F.col("text"))
    rows = selected.filter("selected").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("sel_rank", line.alias("line")))).alias("ls"))
    return rows.select("query_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("block"))
