"""Keyword search by bounds against the score of every pair of query and text."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import retrieval as R

QUERY, TEXT = "query_id long, query string", "id long, text string"


def every_pair(queries, docs, k):
    """The k best of all pairs, scored by the Column."""
    pairs = queries.filter("query_id is not null").crossJoin(docs.filter("id is not null"))
    q, t = T.tokens(F.col("query"), T.KEYWORD_STOPS), T.tokens(F.col("text"), T.KEYWORD_STOPS)
    scored = pairs.select("query_id", "id", F.round(T.keyword_score(q, t, T.light(F.col("text"))), 9).alias("score")).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())


WORDS = "graph Graphs graph_node data dat metadata a the of x xy 42 142 图 图谱 知识图谱 知识图 北京 北京大学 什么 new-york e.g. Ünal ünal straße\tI".split(" ")


@pytest.mark.parametrize("seed", range(3))
def test_equals_every_pair(spark, seed):
    draw = random.Random(seed)
    text = lambda most: draw.choice([" ", "  ", "\n", "_", "，"]).join(draw.choices(WORDS, k=draw.randint(0, most)))
    queries = spark.createDataFrame([(i, text(12)) for i in range(40)] + [(90, None), (None, "graph"), (91, "知识图谱 graph"), (92, "the of")], QUERY)
    docs = spark.createDataFrame([(i, text(25)) for i in range(120)] + [(200, None), (None, "graph"), (201, ""), (202, "x graph node data"), (203, "x " * 5000 + "知识图谱 graph")], TEXT)
    for k in (1, 5, 500):
        assert rows(R.keyword_search(queries, docs, k)) == rows(every_pair(queries, docs, k))


def test_blocks_ties_repeats_and_empty_tables(spark, monkeypatch):
    queries = spark.createDataFrame([(1, "alpha beta"), (1, "gamma"), (2, "beta"), (3, "lph")], QUERY)
    docs = spark.createDataFrame([(9, "alpha beta"), (5, "beta alpha"), (5, "alpha beta"), (7, "beta"), (8, "gamma"), (6, "alphabet")], TEXT)
    whole = rows(R.keyword_search(queries.filter("query <> 'gamma'"), docs, 2))
    assert whole == rows(every_pair(queries.filter("query <> 'gamma'"), docs, 2))
    monkeypatch.setattr(R, "BLOCK_TOKENS", 1)
    assert rows(R.keyword_search(queries.filter("query <> 'gamma'"), docs, 2)) == whole
    assert R.keyword_search(queries.limit(0), docs, 2).isEmpty() and R.keyword_search(queries, docs.limit(0), 2).isEmpty()
    with pytest.raises(ValueError):
        R.keyword_search(queries, docs, 0)
