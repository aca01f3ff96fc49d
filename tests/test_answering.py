"""Answers by rules over the demo facts."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import answering as A
from evigraph.operators import evidence as E
from tests.test_functions import one

EDGES = [("barack_obama", "spouse", "michelle_obama"), ("barack_obama", "born_in", "hawaii"), ("michelle_obama", "occupation", "lawyer"), ("hawaii", "located_in", "united_states")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, r, b, 1.0, 0) for a, r, b in EDGES], "src string, relation string, dst string, score double, ord int")


@pytest.mark.parametrize("key, name", [("barack_obama", "Barack Obama"), ("bank-of_the_west", "Bank of the West"), ("New York", "New York"), ("", ""), ("__", "__"), ("iPhone", "IPhone")])
def test_display(spark, key, name):
    assert one(spark, A.display(F.col("k")), k=key) == name


@pytest.mark.parametrize("query, group", [("Barack Obama 的妻子是谁？", "spouse"), ("where was he born", "birth_place"), ("首都", "capital"), ("hello", None)])
def test_intent(spark, query, group):
    assert one(spark, A.intent(F.col("q")), q=query)["group"] == group


def test_canonical_and_label(spark):
    assert one(spark, A.canonical(F.col("r")), r=" Place of-Birth ") == "birth_place" and one(spark, A.label(F.col("r")), r="knows") == "knows"


def test_sanitize(spark):
    assert one(spark, A.sanitize(F.col("a")), a="The Knowledge Graph says\nroute: x\nKG ok") == "The 已有信息 says\n当前系统 ok"


def test_answers(spark, edges):
    asked = [
        (1, "Barack Obama 的妻子是谁？", ["barack_obama"], "Barack Obama 的妻子是 Michelle Obama。", "rule"),
        (2, "Where was Barack Obama born?", ["barack_obama"], "Barack Obama 的出生地是 Hawaii。", "rule"),
        (3, "Barack Obama 和 Michelle Obama 有什么关系？", ["barack_obama", "michelle_obama"], "Barack Obama 和 Michelle Obama 是配偶关系。", "rule"),
        (4, "Tell me of nobody", ["nobody"], "目前可用信息不足", "unanswerable"),
    ]
    q = spark.createDataFrame([(i, t, e) for i, t, e, _, _ in asked], "query_id long, query string, entities array<string>")
    got = {r["query_id"]: r for r in A.answer(q, E.retrieve(edges, q)).collect()}
    for i, _, _, words, kind in asked:
        assert words in got[i]["answer"] and got[i]["generation_type"] == kind and bool(got[i]["citations"]) == (kind == "rule")


def test_precedence(spark, edges):
    q = spark.createDataFrame([(1, "x", ["barack_obama"], True, True, "Who?", None, None), (2, "x", ["barack_obama"], False, True, None, None, None), (3, "x", ["no"], None, None, None, ["Foo", " "], None), (4, "x", ["no"], None, None, None, None, "Too little.")],
        "query_id long, query string, entities array<string>, clarify boolean, failed boolean, clarifying_question string, ungrounded array<string>, scoring_reason string")
    got = {r["query_id"]: r for r in A.answer(q, E.retrieve(edges, q)).collect()}
    assert got[1]["answer"] == "Who?" and got[2]["generation_type"] == "error_fallback" and "“Foo”" in got[3]["answer"] and got[4]["answer"].startswith("Too little.")
