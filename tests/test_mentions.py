"""Mentions found by rules; the expected ones are worked out by hand."""

import pytest

from evigraph.operators import mentions as M

CASES = [
    ("Barack Obama 的妻子是谁？", [("Barack Obama", 0, 12, 0.93), ("Obama", 7, 12, 0.75)]),
    ("What is Michelle Obama's occupation?", [("Michelle Obama", 8, 22, 0.93)]),
    ("Who is the wife of Barack Obama?", [("B", 19, 20, 0.93), ("Barack Obama", 19, 31, 0.82)]),
    ("姚明和 NBA 有什么关系？", [("姚明", 0, 2, 0.9), ("NBA", 4, 7, 0.9)]),
    ("《三体》的作者是谁？", [("三体", 1, 3, 0.95)]),
    ("介绍一下姚明", [("姚明", 4, 6, 0.82)]),
    ("tell me about the New  York City", [("New York City", 18, 32, 0.82)]),
    ("\"Tesla Inc\" 'x'", [("Tesla Inc", 1, 10, 0.95)]),
    ("Where was Barack Obama born?", [("Barack Obama", 10, 22, 0.93)]),
    ("123 ?", []),
    ("", []),
    ("  \n", []),
    (None, []),
]


def test_extract(spark):
    d = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "query_id long, query string")
    got = {}
    for r in M.extract(d).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["mention"], r["start"], r["end"], r["confidence"]))
    assert [got.get(i, []) for i in range(len(CASES))] == [want for _, want in CASES]


def test_limits_repeats_and_other_columns(spark):
    names = " , ".join(f"Ab{c}" for c in "cdefghijklm")
    d = spark.createDataFrame([(1, names, "x"), (1, names, "x"), (2, "Tesla " * 4000, "x")], "query_id long, query string, mention string")
    out = M.extract(d, max_mentions=3).collect()
    assert [r["mention"] for r in out if r["query_id"] == 1] == ["Abc", "Abd", "Abe"] * 2
    assert M.extract(d, min_confidence=0.8).filter("query_id = 1").isEmpty() and M.extract(d.limit(0)).isEmpty()


@pytest.mark.parametrize("text, ok", [("A", True), ("a", False), ("妻子", False), ("12", False), ("__", False), ("x" * 81, False), ("Wife", False), ("ok", True)])
def test_valid(spark, text, ok):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(M.valid(d["t"])).first()[0] is ok
