"""Mentions that a model's answer tells, read from its text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import mentions as M

#: Confidence of a mention whose answer gives none.
USUAL = 0.8


def mentions(answers: DataFrame) -> DataFrame:
    """query_id, ord, mention, start, end, type, confidence of every answer (query_id, query, output).

    What stands from the first [ to the last ] of an output is read as JSON once a row; an output without such a stretch,
    or with one that is no JSON, tells nothing. Items that are no objects, or whose text is missing, null, blank or
    cleaned away, go. Places that are not both whole numbers are looked for in the question; mentions without a place, or
    with one that is empty or begins before the question, go. Type is unknown and confidence USUAL where none is told or
    it is no number. ord is the item's place in the answer.
    """
    block = F.regexp_extract(F.coalesce("output", F.lit("")), r"(?s)\[.*\]", 0)
    items = F.expr("try_variant_get(_v, '$[0]', 'array<variant>')")
    get = lambda name, kind: F.expr(f"try_variant_get(_x, '$.{name}', '{kind}')")
    whole = lambda name: F.when(F.expr(f"schema_of_variant(variant_get(_x, '$.{name}', 'variant'))") == "BIGINT", get(name, "int"))
    read = answers.select("query_id", M._strip(F.coalesce("query", F.lit(""))).alias("query"), F.try_parse_json(F.concat(F.lit("["), F.nullif(block, F.lit("")), F.lit("]"))).alias("_v"))
    # within a list, as the parser would pass over what comes after a first value
    read = read.filter("size(try_variant_get(_v, '$', 'array<variant>')) = 1")
    told = read.select("query_id", "query", F.posexplode(items).alias("ord", "_x")).filter("schema_of_variant(_x) like 'OBJECT%'")
    told = told.select(
        "query_id", "query", "ord", M.clean(F.array(M._strip(F.coalesce(get("text", "string"), F.lit("")))))[0].alias("mention"), whole("start").alias("_s"), whole("end").alias("_e"),
        F.coalesce(F.nullif(get("type", "string"), F.lit("")), F.lit("unknown")).alias("type"), F.coalesce(get("confidence", "double"), F.lit(USUAL)).alias("confidence"),
    ).filter(M.valid(F.col("mention")))
    at, given = M.span(F.col("query"), F.col("mention")), F.col("_s").isNotNull() & F.col("_e").isNotNull()
    out = told.withColumn("_at", at).select("query_id", "ord", "mention", F.when(given, F.col("_s")).otherwise(F.col("_at.start")).alias("start"), F.when(given, F.col("_e")).otherwise(F.col("_at.end")).alias("end"), "type", "confidence")
    return out.filter("start >= 0 and `end` > start")
