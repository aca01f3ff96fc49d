"""Candidates of mentions and their nodes, on a small set of names."""

from evigraph.operators import resolve as R

ENTITIES = [(1, "n1", "Barack Obama"), (2, "n2", "Michelle Obama"), (3, "n3", "Hawaii"), (4, "n4", "barack_obama")]


def tables(spark, said):
    e = spark.createDataFrame(ENTITIES, "id long, node_key string, name string")
    return spark.createDataFrame(said, "query_id long, mention string"), R.aliases(e.filter("id < 4")), e


def test_candidates(spark):
    m, amap, e = tables(spark, [(1, "barack obama"), (1, "barack obama"), (2, "hawaii islands sea"), (3, None), (None, "Hawaii"), (4, "obama obama obama michelle"), (5, "Hawaii hawaii the")])
    got = {}
    for r in R.candidates(m, amap, e, R.name_search(e)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["node_key"], round(r["score"], 3), r["source"], r["selected"], r["status"]))
    assert [c[0] for c in got[1]] == ["n1", "n2", "n3"] and got[1][0][1:] == (1.0, "alias_map", True, "selected") and got[1][1][2] == "vector"
    assert got[2][0] == ("n3", 0.577, "vector", False, "need_confirmation")
    assert got[4][0][0] == "n2" and got[4][0][3] and got[4][0][1] == 0.894
    assert got[5][0] == ("n3", 0.894, "vector", True, "selected") and set(got) == {1, 2, 4, 5}


def test_empty_tables(spark):
    m, amap, e = tables(spark, [])
    assert R.candidates(m, amap, e, R.name_search(e)).isEmpty()


def test_ground_candidates(spark):
    cols = "query_id long, mention string, rank int, id long, node_key string, name string, score double, source string, selected boolean"
    found = spark.createDataFrame([(1, "a", 1, 1, "gone", "Barack_Obama", 0.9, "vector", True), (1, "a", 2, 2, "n2", "x", 0.95, "vector", False), (1, "b", 1, 3, "n3", "Hawaii", 0.2, "vector", False), (1, "c", 1, 9, "none", "none", 1.0, "vector", True)], cols)
    nodes = spark.createDataFrame([(k, n) for _, k, n in ENTITIES], "node_key string, name string")
    rows = [tuple(r) for r in R.ground_candidates(found, nodes, 0.1).orderBy("rank").collect()]
    assert rows == [(1, "a", "n1", "normalized_entity_name", 0.9, 1), (1, "b", "n3", "direct_node_key", 0.2, 2)]
    assert R.ground_candidates(found, nodes, 0.5, 1).count() == 1
