"""Lines of runs from a table and from a stream against a plain loop, with late, repeated and failing events."""

import json
import os
import random

import pytest

from evigraph.streaming import runs

EVENT = "request_id string, seq long, kind string, payload string, ts timestamp"


def _loop(events):
    """Every run's lines: events in order, once, up to the first end, error or gap."""
    out = {}
    for run in sorted({e[0] for e in events if e[0] is not None and e[1] is not None and e[1] >= 0}):
        held = {}
        for _, seq, kind, payload, ts in sorted((e for e in events if e[0] == run and e[1] is not None and e[1] >= 0), key=lambda e: (e[4], e[2] or "", e[3] or "")):
            held.setdefault(seq, (kind, payload))
        at, done = 0, False
        while at in held and not done:
            kind, payload = held[at]
            out[run, at] = json.loads(runs.event_line(run, at, payload))
            at, done = at + 1, kind in ("end", "error")
        if not (done and held[at - 1][0] == "end"):
            out[run, at] = {"request_id": run, "error": {"error_code": "stream_execution_failed", "message": "The stream terminated unexpectedly."}}
    return out


def _t(second):
    return f"2029-01-01 00:{second // 60:02}:{second % 60:02}"


def _events():
    rng = random.Random(1)
    rows = []
    for run in range(12):
        n = rng.randint(1, 8)
        for seq in range(n):
            kind = "end" if seq == n - 1 and run % 3 else "error" if seq == n - 1 and run % 2 else "step"
            body = {"node": f"n{seq}", "Config": {"secret": 1}, "deep": [{"memory_context": "x", "keep": seq}], "traces": [seq, {"a": None}], "warnings": "no list"}
            rows.append((f"r{run}", seq, kind, json.dumps(body), _t(run * 10 + seq)))
    rows.append(("r1", 40, "step", "{}", _t(200)))  # after the end, or beyond a gap
    rows += [("gap", 0, "step", "not json é", _t(3)), ("gap", 2, "end", None, _t(4)), ("late", 1, "end", "[1]", _t(5)), ("odd", 0, "end", "NaN", _t(6)), (None, 0, "end", "{}", _t(1)), ("x", None, "end", "{}", _t(1)), ("x", -1, "end", "{}", _t(1))]
    return rows


def _told(rows):
    return {(r["request_id"], r["seq"]): json.loads(r["value"]) for r in rows}


def _frame(spark, rows):
    return spark.createDataFrame(rows, "request_id string, seq long, kind string, payload string, ts string").selectExpr("request_id", "seq", "kind", "payload", "cast(ts as timestamp) as ts")


def test_table_equals_a_loop(spark):
    rows = _events()
    again = rows + [(a, b, c, '{"second": true}', _t(3000)) for a, b, c, _, _ in rows[::3]]
    random.Random(2).shuffle(again)
    got = runs.lines(_frame(spark, again).repartition(5)).collect()
    assert len(got) == len(_told(got)) and _told(got) == _loop(again)
    assert runs.lines(_frame(spark, rows).limit(0)).isEmpty()


@pytest.mark.parametrize("value, want", [({"Runtime": 1, "a": {"CONFIG": [1]}}, {"Runtime": "[redacted]", "a": {"CONFIG": "[redacted]"}}), ([{"graph_store": None}], [{"graph_store": "[redacted]"}]), ("config", "config"), (None, None)])
def test_redaction(value, want):
    assert runs.redact(value) == want


def test_deep_values_are_cut():
    value = leaf = []
    for _ in range(20):
        leaf.append([])
        leaf = leaf[0]
    text = json.dumps(runs.redact(value))
    assert text == "[" * 13 + '"[truncated]"' + "]" * 13


def test_lists_add_up(spark):
    rows = [("a", 1, "end", '{"traces": [3], "warnings": ["w"]}', _t(2)), ("a", 0, "step", '{"traces": [1, {"x": null}], "tool_calls": {}}', _t(1)), ("a", 0, "step", '{"traces": [9]}', _t(9)), ("b", 0, "end", "broken", _t(1)), ("c", 0, "end", None, _t(1))]
    got = sorted(tuple(r) for r in runs.appended(_frame(spark, rows)).collect())
    assert got == [("a", "traces", 0, "1"), ("a", "traces", 1, '{"x":null}'), ("a", "traces", 2, "3"), ("a", "warnings", 0, '"w"')]


def test_stream_equals_the_table(spark, tmp_path):
    rows = [e for e in _events() if e[1] != 40]
    rng = random.Random(3)
    parts = [[] for _ in range(4)]
    for e in rows:
        parts[rng.randrange(4)].append(e)
    parts[2] += [(a, b, c, '{"second": true}', t) for a, b, c, _, t in parts[0][:6]]  # repeated
    parts.append([("clock", 0, "end", "{}", "2029-01-02 00:00:00")])  # lets the watermark pass all others
    parts.append([("clock2", 0, "end", "{}", "2029-01-03 00:00:00")])
    source = tmp_path / "in"
    os.makedirs(source)
    for k, part in enumerate(parts):
        _frame(spark, part).write.json(str(tmp_path / f"part{k}"))
        text = "".join(p.read_text() for p in sorted((tmp_path / f"part{k}").glob("*.json")))
        (source / f"{k}.json").write_text(text)
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(source))
        query = runs.stream_lines(stream, "1 hour", 3_600_000).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        got = spark.table("told").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(got) == len(_told(got)) and {k: v for k, v in _told(got).items() if not k[0].startswith("clock")} == _loop(rows)
