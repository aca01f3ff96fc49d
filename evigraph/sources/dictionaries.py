"""Dictionaries of names: dense ids without a single task, relation records, alias maps in the order of their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.sources.workspace import folder

#: Records of which a task makes aliases.
RECORDS = 50_000
# Where an alias record may name its entity, and which of its ids are aliases too.
NAMES = ("entity_name", "name", "entity", "title", "label")
IDS = ("entity_id", "id", "node_id", "node_key", "key")


def dense_ids(names: DataFrame, name: str, held: DataFrame | None = None) -> DataFrame:
    """name, id (long, gapless from 0) of every distinct name, in the order of the names' bytes.

    With held (name, id), names that have an id keep it and new ones come after the greatest, so that ids stay as names
    are added. Null is no name. Names are dealt to ranges once, each range numbers its own and adds what comes before it;
    only one number a range meets in one place.
    """
    spark = names.sparkSession
    new, start = names.select(F.col(name).alias("name")).filter("name is not null").distinct(), 0
    if held is not None:
        held = held.select("name", F.col("id").cast("long").alias("id"))
        start = held.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        new = new.join(held, "name", "left_anti")
    where = folder(spark, "ids")
    # written once, as ranges drawn anew could differ between the two reads
    new.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "name").withColumn("part", F.spark_partition_id()).write.parquet(where)
    ranges = spark.read.schema("name string, part int").parquet(where)
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + start).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    out = ranges.withColumn("own", own).join(F.broadcast(before), "part").select("name", (F.col("before") + F.col("own") - 1).cast("long").alias("id"))
    return out if held is None else held.unionByName(out)


def relations(ids: DataFrame) -> DataFrame:
    """relation_code, internal_relation_id, name, description, metadata of every (name, id); codes are trimmed."""
    code = F.trim("name")
    return ids.select(code.alias("relation_code"), F.col("id").alias("internal_relation_id"), code.alias("name"), F.lit("").alias("description"), F.create_map(F.lit("source"), F.lit("raw_relation2ids")).alias("metadata"))


def _text(x: str) -> Column:
    return T.strip(F.col(x).cast("string"))


def alias_entries(entities: DataFrame, first_wins: bool = False) -> DataFrame:
    """alias_key, entity_id, entity_name, node_key, type, aliases: every alias with the record that owns it.

    entities has entity_id, entity_name, node_key, type, aliases (array of strings) and ord, the place of its writer. Its
    name, key, id and aliases are aliases, as they are and in lower case; the last writer of an alias owns it, or the
    first one. An empty key is the name, an empty type is entity; writers of one place go by key and id, those of none come first.
    """
    name = F.coalesce(F.col("entity_name").cast("string"), F.lit(""))
    key = F.coalesce(F.nullif(F.col("node_key").cast("string"), F.lit("")), name)
    one = entities.select(
        F.coalesce(F.col("entity_id").cast("string"), F.lit("")).alias("entity_id"), name.alias("entity_name"), key.alias("node_key"), F.coalesce(F.nullif("type", F.lit("")), F.lit("entity")).alias("type"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.col("ord").cast("long").alias("ord"),
    )
    # dealt to tasks of so many records, as each becomes several rows
    one = one.repartition(-(-entities.count() // RECORDS) or 1, "node_key", "entity_id")
    said = F.transform(F.concat(F.array("entity_name", "node_key", "entity_id"), "aliases"), T.strip)
    long = one.withColumn("alias_key", F.explode(F.array_distinct(F.concat(said, F.transform(said, F.lower))))).filter("alias_key <> ''").withColumn("_o", F.coalesce("ord", F.lit(-(2**63))))
    # the best place of each alias is a number, found without sorting; only the records there are compared whole
    best = long.groupBy("alias_key").agg((F.min if first_wins else F.max)("_o").alias("_o"))
    record, place = F.struct("entity_id", "entity_name", "node_key", "type", "aliases"), F.struct("ord", "node_key", "entity_id")
    return long.join(best.hint("merge"), ["alias_key", "_o"]).groupBy("alias_key").agg((F.min_by if first_wins else F.max_by)(record, place).alias("r")).select("alias_key", "r.*")


def alias_map(entries: DataFrame, first_wins: bool = False) -> DataFrame:
    """alias_key, entity_name from (key, value, ord), where value is JSON of one of three shapes.

    A text: key is an alias of it. A list: its texts are aliases of key. An object: key, the entity's name, its ids and
    its aliases are aliases of the name that the object gives, or else of key. Aliases are normalised as mentions, names
    as entity names; empty ones go, and so do values of other kinds. The last writer by ord owns an alias, or the first.
    """
    raw = F.trim("value")
    kind = F.substring(raw, 1, 1)
    fields = F.from_json(raw, "map<string,string>")
    items = F.from_json(raw, "array<string>")
    told = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))
    parsed = entries.select("key", F.col("ord").cast("long").alias("ord"), kind.alias("kind"), F.when(kind == "{", fields).alias("fields"), F.when(kind == "[", items).alias("items"), F.when(kind == '"', told).alias("told"))
    at = lambda n: F.try_element_at("fields", F.lit(n))
    named = F.coalesce(*(F.nullif(T.strip(at(n)), F.lit("")) for n in NAMES), F.col("key"))
    entity = T.entity_name(F.when(F.col("kind") == '"', F.col("told")).when((F.col("kind") == "[") & F.col("items").isNotNull(), F.col("key")).when(F.col("fields").isNotNull(), named))
    more = F.when(at("aliases").startswith("["), F.from_json(at("aliases"), "array<string>")).otherwise(F.array(at("aliases")))
    none = F.array().cast("array<string>")
    others = F.when(F.col("kind") == "[", F.col("items")).when(F.col("kind") == "{", F.concat(F.array(*map(at, IDS)), F.coalesce(more, none)))
    long = parsed.select(entity.alias("entity_name"), "ord", F.explode(F.concat(F.array("key"), F.coalesce(others, none), F.when(F.col("kind") == '"', none).otherwise(F.array(entity)))).alias("a"))
    long = long.select("entity_name", "ord", T.mention(F.col("a")).alias("alias_key")).filter("alias_key <> '' and entity_name <> ''")
    return long.groupBy("alias_key").agg((F.min_by if first_wins else F.max_by)("entity_name", F.struct("ord", "entity_name")).alias("entity_name"))
