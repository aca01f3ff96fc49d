"""Records of odd shapes, one at a time: broken, null, nested, of wrong types, with clashing names."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evigraph.sources import normalize as N


def _frame(spark, records):
    return spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "i long, record string")


BAD = [None, "", "{", "null", "7", "true", [1, {"text": "x"}], {}, {"text": " \t"}, {"text": None, "name": ""}, json.dumps(" ")]


def test_bad_records_give_no_rows(spark):
    d = _frame(spark, BAD)
    for out in (N.hits(d, "record", "v"), N.candidates(d.withColumn("g", F.lit(1)), "record", "g", "i"), N.evidence(d, "record"), N.entities(d, "record"), N.hits(d.limit(0), "record", "v")):
        assert out.collect() == []


def test_hits(spark):
    records = [
        {"content": " a ", "text": "", "id": " ", "vector_id": 5, "score": None, "similarity": 0.9, "metadata": {"x": [1, 2], "n": None}, "zz": {"k": 1}},
        json.dumps(" bare "), {"title": "t", "distance": "0.25"}, {"body": "b", "confidence": "high", "distance": 0.1}, {"text": 12, "score": -3}, {"text": "e", "distance": None, "metadata": [1]}, {"text": "f", "score": "1e9", "source": "s"},
    ]
    got = [r.asDict() for r in N.hits(_frame(spark, records), "record", "vector", 0.4, ["i"]).orderBy("i").collect()]
    ret = lambda t: "ret_" + hashlib.md5(t.encode()).hexdigest()[:16]
    assert [(g["id"], g["text"], g["score"], g["distance"]) for g in got] == [("5", "a", 0.4, None), (ret("bare"), "bare", 0.4, None), (ret("t"), "t", 0.75, 0.25), (ret("b"), "b", 0.4, 0.1), (ret("12"), "12", 0.0, None), (ret("e"), "e", 0.0, None), (ret("f"), "f", 1.0, None)]
    assert got[0]["metadata"] == {"x": "[1,2]", "n": None} and got[0]["rest"] == {"zz": '{"k":1}'} and got[5]["metadata"] == {} and got[6]["rest"] == {"source": "s"}
    assert {g["source"] for g in got} == {"vector"} and got[1]["retrieval_sources"] == ["vector"] and all(g["score"] == g["raw_score"] for g in got)


def test_candidates_are_ranked_in_their_group(spark):
    records = [{"text": "a", "rerank_score": 0.2, "score": 0.9}, {"note": 1}, json.dumps("b"), {"text": "c", "rank": 9, "source_type": "kg"}, {"text": "d", "evidence_id": "e1", "extra": True}]
    d = _frame(spark, records).withColumn("g", F.lit("q"))
    got = N.candidates(d, "record", "g", "i").orderBy("rank").collect()
    assert [(r["rank"], r["text"], r["score"], r["source"]) for r in got] == [(1, "a", 0.2, "unknown"), (2, "b", 0.5, "unknown"), (4, "d", 0.0, "unknown"), (9, "c", 0.0, "kg")]
    assert got[2]["id"] == "e1" and got[2]["rest"] == {"extra": "true"} and got[0]["id"].startswith("cand_")


def test_entities(spark):
    records = [
        {"id": 7, "title": "T", "aliases": [" a ", "b", "a", "", None, 3], "alias": "z", "metadata": {"id": "kept", "type": "old", "source": "mine"}},
        {"name": "Only", "alias": "p；q,p; ", "aliases": []},
        {"entity_type": "x", "label": "L", "summary": "s", "metadata": "no"},
    ]
    got = [r.asDict() for r in N.entities(_frame(spark, records), "record", ["i"]).orderBy("i").collect()]
    assert [(g["entity_id"], g["entity_name"], g["node_key"], g["type"], g["aliases"], g["description"]) for g in got] == [
        ("7", "T", "7", "entity", ["a", "b", "3"], ""),
        ("Only", "Only", "Only", "entity", ["p", "q"], ""),
        ("L", "L", "L", "x", [], "s"),
    ]
    assert got[0]["metadata"] == {"id": "kept", "type": "entity", "source": "mine", "node_key": "7", "entity_id": "7", "entity_name": "T"} and got[1]["metadata"]["source"] == "vector_builder"


@pytest.mark.parametrize(
    "record, text, kind, score",
    [
        ({"head": "A", "tail": "B"}, "A --related_to--> B", "text", 0.0),
        ({"source": "A", "predicate": "r", "weight": 0.5, "type": "relation"}, "A", "relation", 0.5),
        ({"path": ["A", 2, None], "distance": 0.5}, "A -> 2 -> ", "text", 0.5),
        ({"path": ["A"], "triples": [{"h": "A", "r": "x", "t": "B"}, "bad", {"subject": "C"}, {}]}, "A --x--> B; C", "text", 0.0),
        ({"relation": "r"}, None, None, None),
        ({"sentence": " said ", "triples": "no", "path": {"a": 1}, "similarity": "0.7"}, "said", "text", 0.7),
        ("bare", "bare", "text", 0.5),
    ],
)
def test_evidence(spark, record, text, kind, score):
    got = N.evidence(_frame(spark, [json.dumps(record)]), "record").collect()
    assert [(r["text"], r["evidence_type"], r["score"]) for r in got] == ([] if text is None else [(text, kind, score)])


def test_evidence_ids(spark):
    rows = N.evidence(_frame(spark, [{"text": "a", "evidence_id": "own"}, {"text": "a"}, {"text": "a"}, {"text": "b"}]), "record", ["i"]).orderBy("i").collect()
    assert rows[0]["evidence_id"] == "own" and rows[1]["evidence_id"] == rows[2]["evidence_id"] != rows[3]["evidence_id"] and len(rows[1]["evidence_id"]) == 15


def test_edge_attributes(spark):
    records = [{"label": "L", "score": "bad", "weight": "0.5"}, {"value": 3}, {"value": None, "score": None}, None, "broken{", {"rel": " r ", "evidence": "told", "similarity": True}]
    d = _frame(spark, records).withColumn("h", F.lit("A")).withColumn("t", F.when(F.col("i") != 3, F.lit("B")))
    got = N.edges(d, "record", "h", "t", ["i"]).orderBy("i").collect()
    assert [(r["relation"], r["score"], r["text"]) for r in got] == [("L", 0.5, "A --L--> B"), ("3", 1.0, "A --3--> B"), ("related_to", 1.0, "A --related_to--> B"), ("related_to", 1.0, "A --related_to--> "), ("related_to", 1.0, "A --related_to--> B"), ("r", 1.0, "told")]
    assert got[0]["attributes"] == {"label": "L", "score": "bad", "weight": "0.5"} and got[3]["attributes"] == {}
