"""Readers and builders on small files."""

import pytest
from pyspark.sql import functions as F

from evigraph.sources import build, readers


def test_id_map(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Barack Obama 0\nnot a number x\n\nHawaii\t2\n")
    assert {r.name: r.id for r in readers.read_id_map(spark, str(tmp_path / "a.txt")).collect()} == {"Barack Obama": 0, "Hawaii": 2}
    (tmp_path / "b.json").write_text('{"a": 1, "b": 2}')
    assert readers.read_id_map(spark, str(tmp_path / "b.json")).count() == 2


def test_triple_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("A a\tr\tB\t7\nx r y\nshort line\n")
    ids = spark.createDataFrame([("A a", 1), ("B", 2)], "name string, id int")
    rel = spark.createDataFrame([("r", 5)], "name string, id int")
    got = sorted((r.head_entity, r.head_id, r.internal_relation_id, r.tail_entity, r.tail_id, r.time_id) for r in readers.read_triple_lines(spark, str(tmp_path / "t.txt"), ids, rel).collect())
    assert got == [("A a", 1, 5, "B", 2, "7"), ("x", None, 5, "y", None, "0")]


def test_csv_synonyms_and_graph(spark, tmp_path):
    (tmp_path / "t.csv").write_text("subject,predicate,object,weight\na,r,B,0.5\n,r,b,1\na,,b,1\n")
    triples = readers.read_triples_csv(spark, str(tmp_path / "t.csv"))
    assert [(r.src, r.relation, r.dst, r.score) for r in triples.collect()] == [("a", "r", "B", 0.5)]
    declared = spark.createDataFrame([("b", "x", "b"), ("lone", "x", "lone")], "node_key string, type string, name string")
    nodes, edges = build.graph(declared, triples)
    assert sorted(r.node_key for r in nodes.collect()) == ["a", "b", "lone"] and edges.first().dst == "b"
    readers.save_graph(nodes, edges, str(tmp_path / "g"))
    assert readers.load_graph(spark, str(tmp_path / "g"))[1].count() == 1
    with pytest.raises(ValueError):
        readers.save_graph(nodes.limit(0), edges, str(tmp_path / "h"))
        readers.load_graph(spark, str(tmp_path / "h"))


def test_alias_list(spark):
    got = spark.createDataFrame([("Obama; obama，奥巴马,,Barack",)], "a string").select(build.alias_list(F.col("a")).alias("x")).first().x
    assert got == ["Obama", "奥巴马", "Barack"]


def test_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"questions": [{"id": "1", "question": "q", "expected_answer": "a", "expected_keywords": ["k"]}]}')
    r = readers.read_cases(spark, str(tmp_path / "c.json")).first()
    assert (r.case_id, r["query"], r.reference_answer, r.keywords) == ("1", "q", "a", ["k"])
    (tmp_path / "d.jsonl").write_text('{"id": "1", "query": "q"}\n{"id": "1", "query": "z"}\n')
    with pytest.raises(ValueError):
        readers.read_cases(spark, str(tmp_path / "d.jsonl"))


def test_manifest(spark, tmp_path):
    (tmp_path / "f.txt").write_text("hello")
    m = readers.manifest(spark, str(tmp_path))
    assert readers.validate_manifest(m, m).count() == 0
    assert readers.validate_manifest(m, m.limit(0)).first().problem == "missing"
