"""From triples and dictionaries to nodes, edges and entity texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entities(id_map: DataFrame) -> DataFrame:
    """node_key, entity_id, name, aliases from (name, id)."""
    return id_map.select(F.col("name").alias("node_key"), F.col("id").cast("string").alias("entity_id"), "name", F.array_distinct(F.array("name", F.lower("name"), F.initcap("name"))).alias("aliases"))


def alias_list(raw: Column) -> Column:
    """Aliases of a text parted by ; or ， or , without blanks, equal ones once whatever their case, in order."""
    items = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[;；，,]"), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def graph(declared: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node_key, type, name) and edges of triples (src, relation, dst, time_id, score, ord).

    Ends of triples that are not declared by key, or by key in lower case, become nodes of their own; isolated nodes stay.
    """
    exact = declared.select(F.col("node_key").alias("k"))
    lower = declared.groupBy(F.lower("node_key").alias("l")).agg(F.min("node_key").alias("by_lower"))

    def resolved(df: DataFrame, end: str) -> DataFrame:
        out = df.join(exact.withColumn("hit", F.lit(True)), F.col(end) == F.col("k"), "left").join(lower, F.lower(end) == F.col("l"), "left")
        return out.withColumn(end, F.when(F.col("hit"), F.col(end)).otherwise(F.coalesce("by_lower", end))).drop("k", "hit", "l", "by_lower")

    edges = resolved(resolved(triples, "src"), "dst").withColumn("relation", F.coalesce(F.nullif(F.trim("relation"), F.lit("")), F.lit("related_to")))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_key")).distinct().join(declared, "node_key", "left_anti")
    nodes = declared.select("node_key", "type", "name").unionByName(ends.select("node_key", F.lit("entity").alias("type"), F.col("node_key").alias("name")))
    return nodes, edges


def entity_document(name: str, entity_id: str, aliases: str, kind: str, description: str) -> Column:
    """The text by which an entity is found: a line for each field that is not empty."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))
    return F.concat_ws("\n", line("实体名称：", F.col(name)), line("实体ID：", F.col(entity_id)), line("别名：", F.array_join(aliases, "、")), line("类型：", F.col(kind)), line("描述：", F.col(description)))
