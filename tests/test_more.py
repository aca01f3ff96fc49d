"""Names, evidence keys, memory scopes, case filters and stores on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import evaluation, evidence, memory, search
from evigraph.sources import readers

AS_OF = "2030-01-01 00:00:00"


def of(spark, rule, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", rule(F.col("t")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    assert of(spark, T.entity_name, "  «Ada»  Lovelace, ", "(Paris)", None, "") == ["«Ada» Lovelace", "Paris", "", ""]
    assert of(spark, T.node_key, "Beyoncé_Knowles-Carter!", None) == ["beyonce knowles carter!", ""]
    assert of(spark, T.clean_mention, "请问Obama是谁？", "The Hague?", "a Theory.", None) == ["Obama", "Hague", "Theory", ""]
    assert of(spark, T.valid_entity, "Obama", "X", "x", "2024", "_-_", "", None, "Who", "x" * 121, "谁") == [True, True, False, False, False, False, False, False, False, False]


EVIDENCE = "query_id long, evidence_type string, source_entity string, relation string, target_entity string, path array<string>, triples array<struct<head:string,relation:string,tail:string>>, score double, text string"


def test_evidence_keys(spark):
    rows = [
        (0, "relation", "A_b", "r", "C", [], [], 0.5, "one"),
        (0, "relation", "a-B", "R", "c", [], [], 0.9, "two"),
        (0, "path", None, None, None, ["x", "Y"], [], 0.4, "three"),
        (0, "path", "", "", "", ["X", "y"], [], 0.3, "four"),
        (0, "note", None, None, None, None, [], 0.2, "Same  text"),
        (0, "other", None, None, None, [], [], 0.1, "same text"),
        (0, "note", None, None, None, [], [], 0.9, None),
    ]
    kept = evidence.fuse(spark.createDataFrame(rows, EVIDENCE)).withColumn("id", evidence.evidence_id()).collect()
    assert sorted(r.text for r in kept) == ["Same  text", "three", "two"]
    assert len({r.id for r in kept}) == 3 and all(len(r.id) == 15 and r.id.startswith("ev_") for r in kept)


MEMORY = "memory_id string, namespace string, user_id string, project_id string, session_id string, content string, status string, expires_at string, updated_at timestamp"


def memories(spark):
    rows = [
        ("m1", "n", "u", "p", None, "x", "active", None, 1),
        ("m2", "n", "u", "p", "s1", "x", "active", None, 2),
        ("m3", "n", "u", "p", "s2", "x", "active", None, 3),
        ("m4", "n", "v", None, "", "x", "active", None, 4),
        ("m5", "n", "u", "p", None, "x", "superseded", None, 5),
        ("m6", "o", "u", "p", None, "x", "active", None, 6),
        ("m7", "n", "u", "p", None, "x", "active", "2020-01-01", 7),
        ("m8", "n", None, None, None, "x", "active", None, 8),
    ]
    return spark.createDataFrame([(*r[:-1], None) for r in rows], MEMORY).drop("updated_at").join(spark.createDataFrame([(r[0], r[-1]) for r in rows], "memory_id string, t int"), "memory_id").select("*", F.timestamp_seconds("t").alias("updated_at")).drop("t")


def test_scopes(spark):
    asked = spark.createDataFrame([(0, "n", "u", "p", "s1"), (1, "n", "u", None, None), (2, "n", None, None, "s2"), (3, None, "u", None, None), (4, "n", "v", "p", None)], "query_id long, namespace string, user_id string, project_id string, session_id string")
    found = {}
    for r in memory.scoped(memories(spark), asked, AS_OF).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.memory_id)
    assert found == {0: ["m2", "m1"], 1: ["m3", "m2", "m1"], 2: ["m8", "m4", "m3", "m1"]}


def test_forget_and_supersede(spark):
    ids = spark.createDataFrame([("m1",), ("m1",), ("none",)], "memory_id string")
    m = memories(spark)
    assert memory.forget(m, ids).count() == 7
    changed = memory.supersede(m, ids)
    assert changed.count() == 8 and changed.filter("memory_id = 'm1'").first().status == "superseded"
    turns = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3)], "request_id string, v int")
    assert memory.unwritten(turns, turns.filter("request_id = 'b'")).count() == 3


def test_cases_and_summary(spark):
    cases = spark.createDataFrame([("1", "a", "easy", None), ("2", "a", "hard", "kg_rag")], "case_id string, category string, difficulty string, expected_route string")
    assert evaluation.filter_cases(cases, "a").count() == 2 and evaluation.filter_cases(cases, "a", expected_route="kg_rag").first().case_id == "2"
    records = spark.createDataFrame([(True, " ", 0, None), (None, "yes", 2, 1), (False, None, None, 3)], "has_error boolean, answer string, num_evidence int, num_grounded_entities int")
    r = evaluation.run_summary(records).first()
    assert (r.total, r.num_errors, r.num_with_answer, r.num_with_evidence, r.num_with_grounded_entities, r.errors_rate) == (3, 1, 1, 1, 2, 0.3333)
    assert evaluation.run_summary(records.limit(0)).first().with_answer_rate == 0.0


def test_store(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, kind string")
    ids = spark.createDataFrame([(1,), (9,)], "id int")
    assert readers.get_by(store, ids).count() == 1 and readers.get_by(store, where=F.col("kind") == "b").count() == 1
    assert sorted(r.id for r in readers.delete_by(store, ids).collect()) == [2, 3]
    assert sorted(r.id for r in readers.delete_by(store, where=F.col("kind") == "b").collect()) == [1, 3]
    assert readers.delete_by(store, ids, F.col("kind") == "b").count() == 3
    with pytest.raises(ValueError):
        readers.delete_by(store)


def test_lines_and_json(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("x 9\ny 1\nx 2\n")
    assert {r.name: r.id for r in readers.read_id_map(spark, str(tmp_path / "ids.txt")).collect()} == {"x": 2, "y": 1}
    (tmp_path / "t.txt").write_text("bad\na r b\nc r d\n")
    none = spark.createDataFrame([], "name string, id int")
    assert readers.read_triple_lines(spark, str(tmp_path / "t.txt"), none, none, max_rows=1).count() == 1
    with pytest.raises(ValueError):
        readers.read_triple_lines(spark, str(tmp_path / "t.txt"), none, none, max_rows=0)
    events = spark.createDataFrame([(1, "k", None)], "id int, token string, note string")
    assert [json.loads(r.value) for r in readers.event_lines(events, ("token", "note")).collect()] == [{"id": 1, "token": "[redacted]"}]
    readers.write_json(events, str(tmp_path / "j"))
    assert readers.read_json(spark, str(tmp_path / "j")).first().token == "k"


def test_subgraph_behind_found_neighbours(spark):
    """Neighbours that are admitted already take places among a node's first, and lose nothing behind them."""
    rows = [("c", f"a{i}") for i in range(3)] + [("a2", f"a{i}") for i in range(2)] + [("a2", f"z{i}") for i in range(5)]
    g = spark.createDataFrame([(a, "r", b, 1.0, i) for i, (a, b) in enumerate(rows)], "src string, relation string, dst string, score double, ord int")
    seeds = spark.createDataFrame([(0, "c")], "query_id long, entity string")
    nodes, _ = search.subgraph_search(g, seeds, max_nodes=6)
    assert sorted(r.id for r in nodes.collect()) == ["a0", "a1", "a2", "c", "z0", "z1"]
