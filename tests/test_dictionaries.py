"""Dense ids, relation records and alias maps."""

from evigraph.sources import dictionaries as D


def test_dense_ids(spark):
    names = spark.createDataFrame([(f"n{i % 300:03d}",) for i in range(900)] + [(None,), ("",), ("é",)], "n string")
    ids = {r["name"]: r["id"] for r in D.dense_ids(names, "n").collect()}
    want = sorted({f"n{i:03d}" for i in range(300)} | {"", "é"}, key=str.encode)
    assert ids == {n: k for k, n in enumerate(want)}
    held = spark.createDataFrame([("n007", 5), ("gone", 9)], "name string, id int")
    more = {r["name"]: r["id"] for r in D.dense_ids(names, "n", held).collect()}
    assert more["n007"] == 5 and more["gone"] == 9 and sorted(v for k, v in more.items() if k not in ("n007", "gone")) == list(range(10, 311))
    assert D.dense_ids(names.limit(0), "n").isEmpty() and D.dense_ids(names.limit(0), "n", held).count() == 2
    assert D.dense_ids(names, "n", held.limit(0)).agg({"id": "min"}).first()[0] == 0


def test_relations(spark):
    row = D.relations(spark.createDataFrame([(" born in ", 3)], "name string, id long")).first()
    assert (row["relation_code"], row["internal_relation_id"], row["description"], row["metadata"]) == ("born in", 3, "", {"source": "raw_relation2ids"})


def test_alias_entries_by_writer(spark):
    rows = [("9", "Ann", "z", "person", ["A ", None, ""], 1), ("8", "ann", "a", None, None, 2), (None, None, None, None, None, 3), ("7", "Bob", "", "", ["A"], None)]
    e = spark.createDataFrame(rows, "entity_id string, entity_name string, node_key string, type string, aliases array<string>, ord long")
    last = {r["alias_key"]: (r["node_key"], r["type"]) for r in D.alias_entries(e).collect()}
    assert last == {"Ann": ("z", "person"), "ann": ("a", "entity"), "z": ("z", "person"), "9": ("z", "person"), "A": ("z", "person"), "a": ("a", "entity"), "8": ("a", "entity"), "Bob": ("Bob", "entity"), "bob": ("Bob", "entity"), "7": ("Bob", "entity")}
    first = {r["alias_key"]: r["node_key"] for r in D.alias_entries(e, True).collect()}
    assert first["ann"] == "z" and first["A"] == "Bob"
    assert D.alias_entries(e.limit(0)).isEmpty()


def test_alias_map_of_three_shapes(spark):
    rows = [
        ("Big Blue", '"IBM"', 1), ("IBM", '["Big_Blue", "i.b.m.", null, 7]', 2), ("ibm corp", '{"name": " ", "title": "IBM", "entity_id": 42, "aliases": ["Mother Blue", ""]}', 3), ("Solo", '{"aliases": "so lo"}', 4),
        ("big blue", '"The Sea"', 5), ("n", "17", 6), ("b", "true", 7), ("broken", '{"name": ', 8), ("broken", "[", 9), (None, '"x"', 10), ("none", None, 11), ("", '["orphan"]', 12), ("empty", '""', 13),
    ]
    got = {r["alias_key"]: r["entity_name"] for r in D.alias_map(spark.createDataFrame(rows, "key string, value string, ord int")).collect()}
    assert got == {"big blue": "The Sea", "ibm": "IBM", "i.b.m": "IBM", "7": "IBM", "ibm corp": "IBM", "42": "IBM", "mother blue": "IBM", "solo": "Solo", "so lo": "Solo"}
