"""Entities: alias maps, mention linking and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import retrieval
from evigraph.operators.mentions import extract


def aliases(nodes: DataFrame, first_wins: bool = False) -> DataFrame:
    """alias_key, node_key: name, lower-cased name and key of every node (node_key, name).

    An alias of several nodes belongs to the last node by key, or to the first with first_wins.
    """
    keys = F.array_distinct(F.array("name", F.lower("name"), "node_key", T.mention(F.col("name"))))
    long = nodes.select("node_key", F.explode(keys).alias("alias_key")).filter("alias_key <> ''")
    pick = F.min("node_key") if first_wins else F.max("node_key")
    return long.groupBy("alias_key").agg(pick.alias("node_key"))


def link(mentions: DataFrame, alias_map: DataFrame) -> DataFrame:
    """Link mentions (query_id, mention) by exact alias or by normalised alias: node_key, confidence (1 or 0.9), null where none."""
    long = mentions.select("query_id", "mention", F.posexplode(F.array("mention", F.lower("mention"), T.mention(F.col("mention")))).alias("tier", "alias_key"))
    hit = long.join(alias_map, "alias_key")
    best = hit.groupBy("query_id", "mention").agg(F.min(F.struct("tier", "node_key")).alias("b"))
    out = mentions.distinct().join(best, ["query_id", "mention"], "left")
    return out.select("query_id", "mention", F.col("b.node_key").alias("node_key"), F.when(F.col("b").isNull(), 0.0).when(F.col("b.tier") == 0, 1.0).otherwise(0.9).alias("confidence"))


def ground(linked: DataFrame, nodes: DataFrame, cap: int = 16) -> DataFrame:
    """Linked mentions whose node is in the graph, one row a node, at most cap a query; column rank."""
    known = linked.filter("node_key is not null").join(nodes.select("node_key").distinct(), "node_key", "left_semi")
    one = known.groupBy("query_id", "node_key").agg(F.max("confidence").alias("confidence"), F.min("mention").alias("mention"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "node_key"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= cap)


#: A vector candidate is chosen by itself from this score and lead over the next one.
SELECT_SCORE, SELECT_MARGIN = 0.72, 0.05


def name_search(entities: DataFrame, dim: int = 384):
    """A search of entity names (id, name) by hashed words: (asked (query_id long, query), k) to query_id, id, score, rank."""

    def dense(df: DataFrame, key: str, text: str) -> DataFrame:
        cells = retrieval.hash_embedding(df, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
        return cells.select(F.col(key).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v"))

    def search(asked: DataFrame, k: int) -> DataFrame:
        return retrieval.knn(dense(asked, "query_id", "query"), dense(entities, "id", "name"), k, "cosine").select("query_id", "id", "score", "rank")

    return search


def candidates(mentions: DataFrame, alias_map: DataFrame, entities: DataFrame, search, k: int = 5) -> DataFrame:
    """Candidates of mentions (query_id, mention): rank, id, node_key, name, score, source, selected, status.

    A mention that is an alias has its entity (id, node_key, name) first, with score 1, selected;
    then follow entities of other names that search finds for the entity's name. Any other mention
    has what search finds for itself; the best is selected from SELECT_SCORE and SELECT_MARGIN up,
    else the status is need_confirmation and none is selected. At most k each. Mentions that are
    equal in one query count once; null ones and those that nothing is found for have no row.
    """
    keyed = entities.select("id", "node_key", "name", T.mention(F.col("name")).alias("_key"))
    linked = link(mentions.filter("query_id is not null and mention is not null").select("query_id", "mention"), alias_map).drop("confidence")
    known = linked.join(keyed, "node_key", "left").withColumn("asked", F.coalesce("name", "mention"))
    texts = known.select(F.xxhash64("asked").alias("query_id"), F.col("asked").alias("query")).dropDuplicates(["query_id"])
    hits = search(texts, k).select(F.col("query_id").alias("_a"), F.col("id"), "score", F.col("rank").alias("_at")).join(keyed, "id")
    named = known.select("query_id", "mention", F.xxhash64("asked").alias("_a"), F.col("_key").alias("_own"), F.col("id").alias("_id"))
    found = named.join(hits, "_a").filter("_own is null or (_key <> _own and _key <> '')")
    same = Window.partitionBy("query_id", "mention", "_key").orderBy("_at")
    found = found.withColumn("_nth", F.row_number().over(same)).filter("_own is null or _nth = 1")
    cols = ["query_id", "mention", "id", "node_key", "name", "score", "source", "_at"]
    alias = known.filter("id is not null").withColumns({"score": F.lit(1.0), "source": F.lit("alias_map"), "_at": F.lit(0)}).select(cols)
    whole = alias.unionByName(found.withColumn("source", F.lit("vector")).select(cols))
    w = Window.partitionBy("query_id", "mention")
    order = w.orderBy("_at", "id")
    whole = whole.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    lead = F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))
    sure = (F.col("rank") == 1) & ((F.col("source") == "alias_map") | ((F.round("score", 9) >= SELECT_SCORE) & (F.round(lead, 9) >= SELECT_MARGIN)))
    whole = whole.withColumn("selected", sure)
    return whole.withColumn("status", F.when(F.max("selected").over(w), "selected").otherwise("need_confirmation")).drop("_at")


def ground_candidates(found: DataFrame, nodes: DataFrame, min_score: float = 0.0, cap: int = 16) -> DataFrame:
    """The node of each mention: its best candidate that the graph has, by node key or else by normalised name; at most cap a query, in order of the mentions.

    Candidates go by selected, score, rank; those below min_score are left out. A name that several
    nodes share stands for the least node key. Columns: query_id, mention, node_key, method, score, rank.
    """
    c = found.filter(F.col("score") >= min_score)
    direct = c.join(nodes.select("node_key").distinct(), "node_key", "left_semi").withColumns({"_node": F.col("node_key"), "method": F.lit("direct_node_key")})
    index = nodes.select(T.node_key(F.col("name")).alias("_key"), "node_key").filter("_key <> ''").groupBy("_key").agg(F.min("node_key").alias("_node"))
    other = c.join(nodes.select("node_key").distinct(), "node_key", "left_anti").withColumn("_key", T.node_key(F.col("name"))).join(index, "_key").withColumn("method", F.lit("normalized_entity_name"))
    cols = ["query_id", "mention", "_node", "method", "score", "selected", "rank"]
    best = F.row_number().over(Window.partitionBy("query_id", "mention").orderBy(F.desc("selected"), F.desc("score"), "rank", "_node"))
    one = direct.select(cols).unionByName(other.select(cols)).withColumn("_b", best).filter("_b = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("mention"))
    return one.withColumn("rank", place).filter(F.col("rank") <= cap).select("query_id", "mention", F.col("_node").alias("node_key"), "method", "score", "rank")


def resolve(questions: DataFrame, alias_map: DataFrame, entities: DataFrame, nodes: DataFrame, search, k: int = 5, min_score: float = 0.0) -> DataFrame:
    """Questions (query_id, query) to nodes of the graph: mentions, their candidates, and these grounded."""
    return ground_candidates(candidates(extract(questions), alias_map, entities, search, k), nodes, min_score)
