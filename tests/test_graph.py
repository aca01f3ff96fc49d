"""Graph searches on small graphs whose results are known."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import evidence, search

DEMO = [
    ("barack", "spouse", "michelle"), ("michelle", "spouse", "barack"), ("barack", "born_in", "hawaii"), ("hawaii", "located_in", "usa"),
    ("michelle", "occupation", "lawyer"), ("barack", "held_position", "president"), ("president", "of_country", "usa"),
]


def graph(spark, rows):
    return spark.createDataFrame([(a, r, b, 1.0, i) for i, (a, r, b) in enumerate(rows)], "src string, relation string, dst string, score double, ord int")


def pairs(spark, *rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "query_id long, source string, target string")


def seeds(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "query_id long, entity string")


def test_relation_forward_and_reverse(spark):
    got = search.relation_search(graph(spark, DEMO), pairs(spark, ("barack", "michelle"), ("lawyer", "usa"))).collect()
    assert sorted((r.head, r.tail, r.direction) for r in got) == [("barack", "michelle", "forward"), ("michelle", "barack", "reverse")]


def test_relation_undirected_retry(spark):
    got = search.relation_search(graph(spark, DEMO), pairs(spark, ("lawyer", "michelle")), include_reverse=False, directed=False).collect()
    assert [(r.head, r.tail, r.direction) for r in got] == [("lawyer", "michelle", "undirected")]


def test_paths(spark):
    got = search.path_search(graph(spark, DEMO), pairs(spark, ("barack", "usa"), ("hawaii", "lawyer"), ("nobody", "nobody"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.path, r.score))
    assert sorted(by[0]) == [(["barack", "hawaii", "usa"], 0.82), (["barack", "president", "usa"], 0.82)]
    assert 1 not in by
    assert by[2] == [(["nobody"], 1.0)]


def test_paths_are_simple_and_bounded(spark):
    g = graph(spark, [("a", "r", "b"), ("b", "r", "a"), ("b", "r", "c"), ("a", "r", "a"), ("c", "r", "d"), ("d", "r", "e")])
    assert [r.path for r in search.path_search(g, pairs(spark, ("a", "c"))).collect()] == [["a", "b", "c"]]
    assert search.path_search(g, pairs(spark, ("a", "e"))).collect() == []
    assert len(search.path_search(g, pairs(spark, ("a", "e")), max_nodes=5).collect()) == 1
    with pytest.raises(ValueError):
        search.path_search(g, pairs(spark, ("a", "e")), max_nodes=13)


def test_neighbors_both(spark):
    got = search.neighbor_search(graph(spark, DEMO), seeds(spark, "barack")).collect()
    assert sorted((r.direction, r.neighbor) for r in got) == [("in", "michelle"), ("out", "hawaii"), ("out", "michelle"), ("out", "president")]


def test_self_loop_counts_once_a_direction(spark):
    got = search.neighbor_search(graph(spark, [("a", "r", "a")]), seeds(spark, "a")).collect()
    assert sorted(r.direction for r in got) == ["in", "out"]


def test_subgraph(spark):
    nodes, edges = search.subgraph_search(graph(spark, DEMO), seeds(spark, "barack", "unknown"), max_depth=1)
    assert sorted((r.id, r.depth) for r in nodes.collect()) == [("barack", 0), ("hawaii", 1), ("michelle", 1), ("president", 1)]
    assert edges.count() == 4


def test_subgraph_caps_nodes_by_key(spark):
    g = graph(spark, [("hub", "r", f"n{i:02d}") for i in range(20)])
    nodes, _ = search.subgraph_search(g, seeds(spark, "hub"), max_nodes=5)
    assert sorted(r.id for r in nodes.collect()) == ["hub", "n00", "n01", "n02", "n03"]


def test_only_the_best_path_survives_fusion(spark):
    q = spark.createDataFrame([(0, ["barack", "usa"], "How is barack related to usa")], "query_id long, entities array<string>, query string")
    fused = evidence.retrieve(graph(spark, DEMO), q)
    assert fused.filter("evidence_type = 'path'").count() == 1
    chosen = evidence.select_evidence(evidence.score_evidence(fused, q))
    verdict = evidence.answerability(q, chosen).first()
    assert verdict.answerability == "answerable" and verdict.n_selected <= 8


def test_no_evidence_is_unanswerable(spark):
    q = spark.createDataFrame([(0, ["x", "y"], "x and y")], "query_id long, entities array<string>, query string")
    chosen = evidence.select_evidence(evidence.score_evidence(evidence.retrieve(graph(spark, DEMO), q), q))
    assert evidence.answerability(q, chosen).first().answerability == "unanswerable"


def test_empty_graph(spark):
    g = graph(spark, DEMO).filter(F.lit(False))
    assert search.relation_search(g, pairs(spark, ("a", "b"))).count() == 0
    assert search.subgraph_search(g, seeds(spark, "a"))[0].count() == 0
