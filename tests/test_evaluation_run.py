"""Records joined with cases, and all metrics of all groups against a plain loop."""

import math

import pytest

from evigraph.operators import evaluation as V
from evigraph.operators import evaluation_run as E

RECORD = "case_id string, answer string, route string, answerability string, has_error boolean, latency_ms double, num_evidence int, num_grounded_entities int, num_warnings int"
CASE = "case_id string, reference_answer string, keywords array<string>, expected_route string, expected_answerability string, category string, difficulty string"
RECORDS = [
    ("c1", "Hello, World!", "kg_rag", "answerable", False, 10.0, 2, 1, 0), ("c2", "Alice works at Example Corp", "KG_RAG ", None, None, 20.0, 0, 0, 1), ("c3", None, "direct_llm", "", True, None, None, None, None),
    ("none", "Alice and Bob", None, "answerable", False, 40.0, 1, 0, 2),
]
CASES = [
    ("c1", "hello world", ["Hello", "!!", "moon"], "kg_rag", "answerable", "a", "hard"), ("c2", "Example Corp", None, "kg_rag", "answerable", " ", None), ("c3", "x", ["x"], None, " ", "a", None), ("c4", "unused", [], "", "", "b", "b"),
]


def test_metrics_of_each_record(spark):
    got = {r["case_id"]: r for r in E.attach(spark.createDataFrame(RECORDS, RECORD), spark.createDataFrame(CASES, CASE)).collect()}
    told = lambda i: tuple(got[i][c] for c in ("has_reference", "exact_match", "contains_match", "keyword_recall", "route_match", "answerability_match", "category", "difficulty"))
    assert told("c1") == (True, True, True, 0.5, True, True, "a", "hard")
    assert told("c2") == (True, False, True, 0.0, True, False, "general", "normal")
    assert told("c3") == (True, False, False, 0.0, None, None, "a", "normal")
    assert told("none") == (False, None, None, 0.0, None, None, "general", "normal")
    assert len(got) == 4


def test_keyword_recall(spark):
    d = spark.createDataFrame([("Alice and Bob", ["Alice", "Bob"]), ("Alice", ["alice!", "Bob"]), ("", ["a"]), ("a", ["."]), (None, None)], "a string, k array<string>")
    assert [r[0] for r in d.select(E.keyword_recall(d.a, d.k)).collect()] == [1.0, 0.5, 0.0, 0.0, 0.0]


def _percentile(values, q):
    at = (len(values) - 1) * q
    lo, hi = math.floor(at), math.ceil(at)
    return values[lo] * (1 - (at - lo)) + values[hi] * (at - lo) if lo != hi else values[lo]


def test_summary_equals_a_loop(spark):
    attached = E.attach(spark.createDataFrame(RECORDS, RECORD), spark.createDataFrame(CASES, CASE))
    rows = [r.asDict() for r in attached.collect()]
    got = {(r["group_by"], r["group"], r["metric"]): r for r in E.summarize(attached).collect()}
    sets = [("all", "", rows)] + [(g, v, [r for r in rows if (r[g] or "") == v]) for g in E.GROUPS for v in {r[g] or "" for r in rows}]
    assert len(got) == len(sets) * (len(E.BOOLEANS) + len(E.NUMBERS))
    for g, v, part in sets:
        for m in E.BOOLEANS:
            values = [bool(r[m]) if m == "has_error" else r[m] for r in part if m == "has_error" or r[m] is not None]
            r = got[g, v, m]
            assert (r["n"], r["hit"], r["avg"], r["p50"]) == (len(values), sum(values), round(sum(values) / len(values), 4) if values else None, None)
        for m in E.NUMBERS:
            values = sorted(float(r[m]) for r in part if r[m] is not None)
            r = got[g, v, m]
            want = [round(x, 4) for x in (sum(values) / len(values), values[0], values[-1], *(_percentile(values, q) for q in (0.5, 0.9, 0.95)))] if values else [0.0] * 6
            assert r["n"] == len(values) and r["hit"] is None and [r[c] for c in ("avg", "min", "max", "p50", "p90", "p95")] == pytest.approx(want)


def test_nothing_to_evaluate(spark):
    attached = E.attach(spark.createDataFrame([], RECORD), spark.createDataFrame(CASES, CASE))
    assert attached.isEmpty() and all(r["n"] == 0 for r in E.summarize(attached).collect())
    with pytest.raises(ValueError):
        V.require_unique_cases(spark.createDataFrame(CASES[:1] * 2, CASE))
