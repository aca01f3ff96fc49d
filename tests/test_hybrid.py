"""Merging of channels, odd vectors, subgraph evidence and report files."""

import math

import pytest

from evigraph.operators import evidence as E
from evigraph.operators import retrieval as R
from evigraph.sources import reports

HIT = "query_id long, id long, score double"


def test_hybrid(spark):
    a = spark.createDataFrame([(1, 7, 0.5), (1, 8, 1.0), (None, 8, 1.0)], HIT)
    b = spark.createDataFrame([(1, 7, 0.9), (1, 7, 0.1)], HIT)
    rows = R.hybrid({"vector": a, "entity": b, "keyword": a.limit(0), "new": a.filter("id = 8")}, 5).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["n_sources"], r["channel"]) for r in rows] == [(8, 0.864, 2, "new"), (7, 0.648, 2, "entity")]
    assert rows[1]["raw_scores"] == {"entity": 0.9, "vector": 0.5}
    assert [r["id"] for r in R.hybrid({"vector": a}, 5, 0.5).collect()] == [8]


@pytest.mark.parametrize("weights", [{"a": -1.0}, {"a": math.nan}, {"a": 0.0}, {}])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        R.check_weights(weights)


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [1.0, None]), (None, [1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (9, [])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["distance"] for r in R.knn(v.filter("id = 1"), v, 20, "cosine").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 8: 1.0, 9: 1.0}
    assert R.knn(v.limit(0), v, 3).isEmpty() and R.knn(v, v.limit(0), 3).isEmpty()


def test_subgraph_evidence(spark):
    edges = spark.createDataFrame([("a", "r", "b", 1.0, 0), ("b", "s", "c", 1.0, 0), ("c", "s", "d", 1.0, 0)], "src string, relation string, dst string, score double, ord int")
    q = spark.createDataFrame([(1, ["a", "b"])], "query_id long, entities array<string>")
    kinds = lambda n: {(r["evidence_type"], r["target_entity"]) for r in E.retrieve(edges, q, subgraph_nodes=n).collect()}
    assert ("subgraph", "d") in kinds(10) and kinds(10) - kinds(0) == {("subgraph", t) for t in "bcd"}


def test_report(spark, tmp_path):
    rows = [("c1", True, None, 0, 0, ["x"]), ("c2", False, "yes", 2, 1, None), ("c3", None, "no", None, 0, [])]
    records = spark.createDataFrame(rows, "case_id string, has_error boolean, answer string, num_evidence int, num_grounded_entities int, tags array<string>")
    reports.write_report(spark, records, str(tmp_path / "r"), "run-1")
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == sorted(reports.PARTS)
    assert spark.read.json(str(tmp_path / "r/errors.jsonl")).first()["case_id"] == "c1"
    assert spark.read.csv(str(tmp_path / "r/records.csv"), header=True).count() == 3
    assert "| total | 3 |" in spark.read.text(str(tmp_path / "r/report.md"), wholetext=True).first()[0]
    reports.write_report(spark, records.limit(0), str(tmp_path / "e"), "run-2")
    assert spark.read.text(str(tmp_path / "e/records.jsonl")).isEmpty()
