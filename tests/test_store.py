"""The store of memories against a plain loop, and a stream that is stopped before its commit and starts again."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from evigraph.streaming import store as S

AT = "2029-05-01 10:00:00"
CANDIDATE = "namespace string, user_id string, project_id string, session_id string, memory_type string, content string, source string, confidence double, expires_at string, metadata map<string,string>, ord long"


def _rows(seed, n=60):
    rng = random.Random(seed)
    said = ["Likes tea", "likes  TEA ", "must be short", "Ünï", "x"]
    return [
        ("kg", rng.choice(["u1", "u2"]), rng.choice(["p", "", None]), rng.choice(["", "s"]), rng.choice(["fact", "note"]), rng.choice(said), rng.choice(["", "a", "b"]), rng.random(), rng.choice([None, "2031-01-01"]), {rng.choice("ab"): str(i)} if i % 2 else {}, i)
        for i in range(n)
    ]


def _loop(held, rows):
    """One batch into a dictionary: all of its rows count against the rows held before."""
    for ns, user, project, session, kind, content, source, confidence, expires, metadata, _ in sorted(rows, key=lambda r: r[-1]):
        content = (content or "").strip()
        if not ns or not content:
            continue
        key = (ns, user or "", project or "", session or "", kind, re.sub(r"\s+", " ", content.lower()))
        row = held.setdefault(key, {"content": content, "source": "agent", "confidence": 0.0, "expires": None, "metadata": {}})
        row["source"] = source or "agent"
        row["confidence"] = max(row["confidence"], confidence)
        row["expires"] = expires or row["expires"]
        row["metadata"].update(metadata)
    return held


def _read(store):
    return {tuple(r[c] for c in S._KEY): {"content": r["content"], "source": r["source"], "confidence": r["confidence"], "expires": r["expires_at"], "metadata": r["metadata"]} for r in store.read().collect()}


def test_batches_equal_a_loop(spark, tmp_path):
    store, held = S.MemoryStore(spark, str(tmp_path / "s"), 4), {}
    assert store.read().collect() == [] and store.version() == 0
    for k in range(3):
        rows = _rows(k) + [(None, "u", "", "", "fact", "no namespace", "", 1.0, None, {}, 99), ("kg", "u", "", "", "fact", " ", "", 1.0, None, {}, 98)]
        d = spark.createDataFrame(rows, CANDIDATE).repartition(3)
        assert store.write(d, AT, batch=k) and not store.write(d, AT, batch=k)
        assert _read(store) == _loop(held, rows) and store.version() == k + 1
    ids = [r["memory_id"] for r in store.read().collect()]
    assert len(set(ids)) == len(ids)
    assert store.write(spark.createDataFrame([], CANDIDATE), AT, batch=9) and _read(store) == held
    assert store.clean() > 0 and _read(store) == held


def test_status_and_forgetting(spark, tmp_path):
    store = S.MemoryStore(spark, str(tmp_path / "s"), 2)
    d = spark.createDataFrame([r for r in _rows(1) if r[5] == "x"][:1], CANDIDATE)
    store.write(d, AT)
    first = store.read()
    store.set_status(first, "superseded", "2029-06-01 00:00:00")
    assert store.read().first()["status"] == "superseded"
    store.write(d, "2029-07-01 00:00:00", batch=1)  # a key that was given up begins anew beside its old row
    assert sorted(r["status"] for r in store.read().collect()) == ["active", "superseded"] and store.read().select("memory_id").distinct().count() == 2
    store.forget(store.read())
    assert store.read().isEmpty()
    store.write(d, AT, batch=2)
    assert store.read().count() == 1
    with pytest.raises(ValueError):
        S.MemoryStore(spark, str(tmp_path / "s"), 3)


def test_one_of_two_writers_fails(spark, tmp_path):
    one, two = S.MemoryStore(spark, str(tmp_path / "s"), 2), S.MemoryStore(spark, str(tmp_path / "s"), 2)
    d = spark.createDataFrame(_rows(1), CANDIDATE)
    held = two._last
    two._last = lambda: None
    one.write(d, AT, "one")
    with pytest.raises(RuntimeError):
        two.write(d, AT, "two")
    two._last = held
    assert two.write(d, AT, "two") and _read(two) == _loop({}, _rows(1))


def test_a_stream_that_is_stopped_before_its_commit(spark, tmp_path):
    source, names = tmp_path / "in", CANDIDATE
    os.makedirs(source)
    batches = [_rows(10 + k, 5) for k in range(4)]
    cols = [c.split()[0] for c in names.replace("map<string,string>", "map").split(", ")]
    for k, rows in enumerate(batches):
        secret = ("kg", "u1", "", "", "fact", "password: hunter2", "", 1.0, None, {}, 500)
        with open(source / f"{k}.json", "w") as f:
            f.write("\n".join(json.dumps(dict(zip(cols, r))) for r in [*rows, secret]))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    store = S.MemoryStore(spark, str(tmp_path / "s"), 3)
    calls = []

    def stop():
        calls.append(store.version())
        if len(calls) == 3:
            raise RuntimeError("stopped between write and commit")

    store._before_commit = stop

    def start():
        stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).json(str(source))
        return S.write_stream(stream, store, str(tmp_path / "check"), "chat", AT, most=100).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="stopped between"):
        start().awaitTermination()
    assert store.version() == 2
    start().awaitTermination()
    held = {}
    for rows in batches:
        _loop(held, rows)
    assert store.version() == 4 and _read(store) == held
    start().awaitTermination()  # nothing new: nothing changes
    assert store.version() == 4 and store.read().filter(F.contains("content", F.lit("hunter2"))).isEmpty()
