"""Records of unlike shape, as JSON, to rows of one shape: hits, candidates, entities, evidence, edges.

A record is parsed once into a VARIANT; which names a field may have, and in which order they are
tried, is data. A record that is broken JSON, null, a bare number or a list gives no row. A text
within a record is stripped; a number or a nested value reads as its JSON text. Fields that no rule
asks for come along in the map ``rest``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import evidence as E

# Names of a field, in the order they are tried.
TEXT = ("text", "content", "document", "page_content", "body")
TITLE = ("entity_name", "entity", "name", "title", "label")
HIT_ID = ("id", "doc_id", "document_id", "vector_id", "entity_id")
CANDIDATE_ID = (*HIT_ID, "evidence_id")
HIT_SCORE = ("score", "similarity", "confidence")
CANDIDATE_SCORE = ("rerank_score", *HIT_SCORE)
EVIDENCE_SCORE = (*HIT_SCORE, "weight")
ENTITY_ID = ("entity_id", "id", "node_id", "node_key", "name", "entity_name")
ENTITY_NAME = ("entity_name", "name", "label", "title", "node_key", "entity_id")
ENTITY_KEY = ("node_key", "entity_id", "id", "entity_name", "name")
ENTITY_TYPE = ("type", "entity_type", "label_type", "category")
ENTITY_TEXT = ("description", "desc", "summary", "text")
EVIDENCE_TYPE, EVIDENCE_TEXT = ("evidence_type", "type"), ("text", "description", "sentence")
SOURCE, TARGET, RELATION = ("source_entity", "source", "head"), ("target_entity", "target", "tail"), ("relation", "predicate", "rel")
TRIPLE_HEAD, TRIPLE_RELATION, TRIPLE_TAIL = ("head", "source", "subject", "h"), ("relation", "predicate", "rel", "r", "type"), ("tail", "target", "object", "t")
EDGE_RELATION = ("relation", "predicate", "rel", "type", "label", "name")
EDGE_SCORE, EDGE_TEXT = ("score", "weight", "confidence", "similarity"), ("text", "description", "sentence", "evidence")
UNNAMED = "related_to"

_MAP = "map<string,variant>"


def _hold(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: a generator, into which no later filter or projection is folded."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _texts(record: Column) -> Column:
    """The fields of an object as stripped texts, null as empty; null for other records."""
    return F.transform_values(F.try_variant_get(record, "$", _MAP), lambda _, x: T.strip(F.try_variant_get(x, "$", "string")))


def first_of(fields: Column, names: Sequence[str], default: str = "") -> Column:
    """The first of the named fields that is not empty; default without any."""
    found = F.filter(F.transform(F.array(*map(F.lit, names)), lambda n: F.try_element_at(fields, n)), lambda x: x != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(default))


def number(record: Column, name: str) -> Column:
    """A field as an array of one finite number, or of none where it isn't one. Numbers may be written as texts, true is 1."""
    return F.filter(F.array(F.try_variant_get(record, f"$.{name}", "double")), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def score_of(record: Column, fields: Column, names: Sequence[str], default: float = 0.0) -> Column:
    """The first named field that is there decides, as default if it is no number; else 1 - distance; else default. In [0, 1]."""
    value = lambda n, other: F.coalesce(F.try_element_at(number(record, n), F.lit(1)), F.lit(float(other)))
    found = F.when(F.map_contains_key(fields, F.lit("distance")), 1.0 - value("distance", 1.0)).otherwise(float(default))
    for n in reversed(names):
        found = F.when(F.map_contains_key(fields, F.lit(n)), value(n, default)).otherwise(found)
    return T.clip(found)


def texts_of(record: Column, name: str) -> Column:
    """A field that is an object as a map of texts; empty otherwise."""
    return F.coalesce(F.transform_values(F.try_variant_get(record, f"$.{name}", _MAP), lambda _, x: F.try_variant_get(x, "$", "string")), F.create_map().cast("map<string,string>"))


def rest_of(record: Column, used: Sequence[str]) -> Column:
    """Fields besides those used, as texts."""
    fields = F.transform_values(F.try_variant_get(record, "$", _MAP), lambda _, x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.map_filter(fields, lambda k, _: ~k.isin(*used)) if used else fields, F.create_map().cast("map<string,string>"))


def put(held: Column, pairs: dict[str, Column]) -> Column:
    """A map with these pairs, which replace what it has of their names."""
    rest = F.map_filter(held, lambda k, _: ~k.isin(*pairs))
    return F.map_concat(rest, F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))))


def _parsed(df: DataFrame, raw: str) -> DataFrame:
    """df with _v and _f, a record and its fields as texts where it is an object, and _s, where it is a text."""
    d = _hold(df, _v=F.try_parse_json(F.col(raw).cast("string")))
    text = F.when(F.schema_of_variant("_v") == "STRING", T.strip(F.try_variant_get("_v", "$", "string")))
    return _hold(d, _f=F.coalesce(_texts(F.col("_v")), F.create_map().cast("map<string,string>")), _s=text)


def _identified(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(text), 1, 16))


def hits(df: DataFrame, raw: str, source: str, default: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """keep, id, text, score, raw_score, distance, source, retrieval_sources, metadata, rest of every record with a text.

    A text alone is its own record of the default score. Without a text a title stands for it;
    without an id ret_ and 16 digits of the text's MD5.
    """
    d, v, f = _parsed(df, raw), F.col("_v"), F.col("_f")
    score = F.when(F.col("_s").isNotNull(), T.clip(F.lit(float(default)))).otherwise(score_of(v, f, HIT_SCORE, default))
    d = _hold(d, text=F.coalesce(F.col("_s"), first_of(f, (*TEXT, *TITLE))), score=score).filter("text <> ''")
    return d.select(
        *keep, F.coalesce(F.nullif(first_of(f, HIT_ID), F.lit("")), _identified("ret_", F.col("text"))).alias("id"), "text", "score", F.col("score").alias("raw_score"), F.try_element_at(number(v, "distance"), F.lit(1)).alias("distance"),
        F.lit(source).alias("source"), F.array(F.lit(source)).alias("retrieval_sources"), texts_of(v, "metadata").alias("metadata"), rest_of(v, (*TEXT, *HIT_ID, *HIT_SCORE, "distance", "metadata")).alias("rest"),
    )


def candidates(df: DataFrame, raw: str, group: str, order: str) -> DataFrame:
    """group, rank, id, text, score, source, metadata, rest of every record with a text, in each group's order.

    A record keeps a rank of its own; others take their place among the group's records that have a
    text, from 1. A text alone scores 0.5. Ids begin with cand_ where a record has none.
    """
    d, v, f = _parsed(df, raw), F.col("_v"), F.col("_f")
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, raw))
    d = _hold(d, text=F.coalesce(F.col("_s"), first_of(f, (*TEXT, *TITLE)))).filter("text <> ''").withColumn("_place", place)
    return d.select(
        group, F.coalesce(F.try_variant_get(v, "$.rank", "int"), F.col("_place")).alias("rank"), F.coalesce(F.nullif(first_of(f, CANDIDATE_ID), F.lit("")), _identified("cand_", F.col("text"))).alias("id"), "text",
        F.when(F.col("_s").isNotNull(), 0.5).otherwise(score_of(v, f, CANDIDATE_SCORE)).alias("score"), first_of(f, ("source_type", "source"), "unknown").alias("source"), texts_of(v, "metadata").alias("metadata"),
        rest_of(v, (*TEXT, *CANDIDATE_ID, *CANDIDATE_SCORE, "rank", "source", "source_type", "distance", "metadata")).alias("rest"),
    )


def aliases_of(record: Column, fields: Column) -> Column:
    """Aliases as a list or as one text parted by ; ； or , without blanks, equal ones once, in order."""
    listed = [F.transform(F.try_variant_get(record, f"$.{n}", "array<variant>"), lambda x: T.strip(F.try_variant_get(x, "$", "string"))) for n in ("aliases", "alias")]
    own = [F.when(F.try_variant_get(record, f"$.{n}", "array<variant>").isNull(), F.nullif(F.try_element_at(fields, F.lit(n)), F.lit(""))) for n in ("aliases", "alias")]
    told = F.transform(F.split(F.coalesce(*own, F.lit("")), "[;；,]"), T.strip)
    return F.array_distinct(F.filter(F.coalesce(*(F.nullif(x, F.array().cast("array<string>")) for x in listed), told), lambda x: x != ""))


def entities(df: DataFrame, raw: str, keep: Sequence[str] = (), source: str = "vector_builder") -> DataFrame:
    """keep, entity_id, entity_name, name, node_key, type, aliases, description, metadata of every record with an id or a name.

    Id and name stand in for each other, the id for the key. metadata is the record's own with
    key, id, name and type put into it, and source where it has none.
    """
    d, v, f = _parsed(df, raw), F.col("_v"), F.col("_f")
    d = _hold(d, _id=first_of(f, ENTITY_ID), _name=first_of(f, ENTITY_NAME), _key=first_of(f, ENTITY_KEY), type=first_of(f, ENTITY_TYPE, "entity"), _own=texts_of(v, "metadata")).filter("_id <> '' or _name <> ''")
    either = lambda a, b: F.when(F.col(a) != "", F.col(a)).otherwise(F.col(b))
    d = _hold(d, entity_id=either("_id", "_name"), entity_name=either("_name", "_id"))
    d = _hold(d, node_key=either("_key", "entity_id"))
    told = {c: F.col(c) for c in ("node_key", "entity_id", "entity_name", "type")} | {"source": F.coalesce(F.try_element_at("_own", F.lit("source")), F.lit(source))}
    return d.select(*keep, "entity_id", "entity_name", F.col("entity_name").alias("name"), "node_key", "type", aliases_of(v, f).alias("aliases"), first_of(f, ENTITY_TEXT).alias("description"), put(F.col("_own"), told).alias("metadata"))


def relation_text(head: Column, relation: Column, tail: Column) -> Column:
    """What an edge says; without a relation only that both ends go together, without an end the other one."""
    both = (head != "") & (tail != "")
    return F.when(both & (relation != ""), F.concat(head, F.lit(" --"), relation, F.lit("--> "), tail)).when(both, F.concat(head, F.lit(" 与 "), tail, F.lit(" 存在相关联系。"))).when(head != "", head).otherwise(tail)


def triples_text(triples: Column) -> Column:
    """Texts of triples (head, relation, tail), parted by '; '."""
    said = F.transform(triples, lambda t: relation_text(t["head"], F.coalesce(F.nullif(t["relation"], F.lit("")), F.lit(UNNAMED)), t["tail"]))
    return F.array_join(F.filter(said, lambda x: x != ""), "; ")


def evidence(df: DataFrame, raw: str, keep: Sequence[str] = ()) -> DataFrame:
    """keep, evidence_id, evidence_type, source_entity, target_entity, relation, path, triples, text, score, metadata of every record that says anything.

    A text alone is evidence of type text and score 0.5. Without a text, the triples, else the path,
    else the ends give one. An id that is missing is made of the content (evidence.evidence_id).
    """
    d, v, f = _parsed(df, raw), F.col("_v"), F.col("_f")
    path = F.transform(F.try_variant_get(v, "$.path", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    fields = F.filter(F.transform(F.try_variant_get(v, "$.triples", "array<variant>"), _texts), lambda t: t.isNotNull())
    triple = lambda t: F.struct(first_of(t, TRIPLE_HEAD).alias("head"), first_of(t, TRIPLE_RELATION).alias("relation"), first_of(t, TRIPLE_TAIL).alias("tail"))
    kind = F.when(F.col("_s").isNotNull(), "text").otherwise(first_of(f, EVIDENCE_TYPE, "text"))
    none = F.array().cast("array<struct<head:string,relation:string,tail:string>>")
    d = _hold(
        d, evidence_type=kind, source_entity=first_of(f, SOURCE), target_entity=first_of(f, TARGET), relation=first_of(f, RELATION), path=F.coalesce(path, F.array().cast("array<string>")), triples=F.coalesce(F.transform(fields, triple), none),
        _text=F.coalesce(F.col("_s"), first_of(f, EVIDENCE_TEXT)), _id=first_of(f, ("evidence_id",)), score=F.when(F.col("_s").isNotNull(), 0.5).otherwise(score_of(v, f, EVIDENCE_SCORE)), metadata=texts_of(v, "metadata"),
    )
    ends = F.when(F.concat("source_entity", "relation", "target_entity") != "", relation_text(F.col("source_entity"), F.coalesce(F.nullif("relation", F.lit("")), F.lit(UNNAMED)), F.col("target_entity")))
    made = F.coalesce(F.nullif(triples_text(F.col("triples")), F.lit("")), F.when(F.size("path") > 0, F.array_join("path", " -> ")), ends, F.lit(""))
    d = _hold(d, text=F.when(F.col("_text") != "", F.col("_text")).otherwise(made)).filter("text <> ''")
    named = F.when(F.col("_id") != "", F.col("_id")).otherwise(E.evidence_id())
    return d.select(*keep, named.alias("evidence_id"), "evidence_type", "source_entity", "target_entity", "relation", "path", "triples", "text", "score", "metadata")


def edges(df: DataFrame, raw: str, head: str, tail: str, keep: Sequence[str] = ()) -> DataFrame:
    """keep, src, dst, relation, score, text, attributes: what an edge's attributes (an object; null is empty) say of it.

    Without a name of the relation its ``value`` stands, else UNNAMED. The score is the first of the
    named fields that is a number, else 1.
    """
    d, v, f = _parsed(df, raw), F.col("_v"), F.col("_f")
    end = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = F.coalesce(F.nullif(first_of(f, EDGE_RELATION), F.lit("")), F.try_variant_get(v, "$.value", "string"), F.lit(UNNAMED))
    score = T.clip(F.coalesce(F.try_element_at(F.concat(*(number(v, n) for n in EDGE_SCORE)), F.lit(1)), F.lit(1.0)))
    d = _hold(d, _src=end(head), _dst=end(tail), relation=named, score=score)
    said = F.concat(F.col("_src"), F.lit(" --"), F.col("relation"), F.lit("--> "), F.col("_dst"))
    return d.select(*keep, F.col("_src").alias("src"), F.col("_dst").alias("dst"), "relation", "score", F.coalesce(F.nullif(first_of(f, EDGE_TEXT), F.lit("")), said).alias("text"), rest_of(v, ()).alias("attributes"))
