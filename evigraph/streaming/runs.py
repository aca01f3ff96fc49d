"""Events of runs as lines of JSON: in order, once, with hidden fields marked, ended by an error line where a run fails.

An event is (request_id, seq, kind, payload, ts): seq counts a run's events from 0, payload is JSON,
kind is ``end`` for the last event, ``error`` for a failure, anything else in between. The same
lines come from a table (lines) and from a stream (stream_lines); a stream holds early events until
those before them come, drops repeated ones, and gives a run up after an idle time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType

# Fields whose contents are hidden, what stands for them, and the line of a failure.
HIDDEN = (
    "config", "raw_state", "runtime", "runtime_context", "llm_client", "embedding_client", "graph_store", "vector_store", "prompt_manager", "memory_manager",
    "tool_registry", "mcp_client_manager", "memory_context", "memory_text", "memory_candidates", "memory_write_result",
)
REDACTED, TRUNCATED, DEEPEST = "[redacted]", "[truncated]", 12
FAILED = {"error_code": "stream_execution_failed", "message": "The stream terminated unexpectedly."}
#: Fields of a payload whose lists add up over a run.
APPENDED = ("traces", "warnings", "tool_calls", "tool_results")
END, ERROR = "end", "error"
LINE = "request_id string, seq long, value string"


def redact(value, hidden: frozenset[str] = frozenset(HIDDEN), depth: int = 0):
    """A JSON value with hidden fields (whatever their case) marked at any depth; what lies deeper than DEEPEST is cut."""
    if depth > DEEPEST:
        return TRUNCATED
    if isinstance(value, dict):
        return {k: REDACTED if k.lower() in hidden else redact(v, hidden, depth + 1) for k, v in value.items()}
    return [redact(v, hidden, depth + 1) for v in value] if isinstance(value, list) else value


def _read(payload: str | None):
    """The payload's value; a text that is no JSON, or holds no finite number, stands for itself."""

    def refuse(word: str):
        raise ValueError(word)

    try:
        return None if payload is None else json.loads(payload, parse_constant=refuse)
    except (ValueError, RecursionError):
        return payload


def event_line(request: str, seq: int, payload: str | None) -> str:
    return json.dumps({"request_id": request, "seq": seq, "event": redact(_read(payload))}, ensure_ascii=False)


def error_line(request: str) -> str:
    return json.dumps({"request_id": request, "error": FAILED}, ensure_ascii=False)


@F.pandas_udf(StringType())
def _event_lines(request: pd.Series, seq: pd.Series, payload: pd.Series) -> pd.Series:
    return pd.Series([event_line(r, int(s), None if p is None or p != p else p) for r, s, p in zip(request, seq, payload)], dtype=object)


def _once(events: DataFrame) -> DataFrame:
    """Events with a run and a number, each number of a run once: the earliest, ties to the smaller kind and payload."""
    d = events.filter("request_id is not null and seq >= 0").select(F.col("request_id").cast("string").alias("request_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("")).alias("kind"), "payload", "ts")
    first = Window.partitionBy("request_id", "seq").orderBy("ts", "kind", "payload")
    return d.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def lines(events: DataFrame) -> DataFrame:
    """request_id, seq, value of a finished table of events.

    A run's lines are its events from 0 on without a gap, up to the first end or error. If there is
    no end, an error line follows, numbered after the last line; so a run whose event 0 is missing
    has an error line alone. Only sums run over a run, so its events are never brought together.
    """
    d = _once(events)
    run = Window.partitionBy("request_id").orderBy("seq")
    d = d.withColumn("_at", F.row_number().over(run) - 1).withColumn("_closed", F.coalesce(F.sum(F.col("kind").isin(END, ERROR).cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = d.filter("seq = _at and _closed = 0")
    told = kept.select("request_id", "seq", _event_lines("request_id", "seq", "payload").alias("value"))
    ends = d.groupBy("request_id").agg(F.coalesce(F.max(F.when((F.col("seq") == F.col("_at")) & (F.col("_closed") == 0), F.col("seq"))), F.lit(-1)).alias("last"), F.coalesce(F.bool_or((F.col("seq") == F.col("_at")) & (F.col("_closed") == 0) & (F.col("kind") == END)), F.lit(False)).alias("ended"))
    code, message = (F.lit(FAILED[k]).alias(k) for k in ("error_code", "message"))
    # the same text as error_line(): separators with a blank
    failed = ends.filter("not ended").select("request_id", (F.col("last") + 1).alias("seq"), F.concat(F.lit('{"request_id": '), _quoted(F.col("request_id")), F.lit(', "error": {"error_code": '), _quoted(code), F.lit(', "message": '), _quoted(message), F.lit("}}")).alias("value"))
    return told.unionByName(failed)


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def appended(events: DataFrame, names: tuple[str, ...] = APPENDED) -> DataFrame:
    """request_id, name, position (from 0), item (JSON): the lists of a run's payloads, one after the other.

    Events count once each by their number, whatever order they come in; fields that are no lists
    add nothing. Items stay rows, so a run of any length is no single value.
    """
    v = F.try_parse_json("payload")
    d = _once(events).withColumn("_v", v)
    lists = F.array(*(F.struct(F.lit(n).alias("name"), F.try_variant_get("_v", f"$.{n}", "array<variant>").alias("items")) for n in names))
    items = d.select("request_id", "seq", F.inline(lists)).select("request_id", "seq", "name", F.posexplode("items").alias("_p", "_i"))
    order = Window.partitionBy("request_id", "name").orderBy("seq", "_p")
    return items.select("request_id", "name", (F.row_number().over(order) - 1).cast("long").alias("position"), F.to_json("_i").alias("item"))


class _Run(StatefulProcessor):
    """State of one run: the next number, whether it is closed, and events that came early."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, closed boolean")
        self.early = handle.getMapState("early", "seq long", "kind string, payload string")

    def _out(self, request: str, rows: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"request_id": [request] * len(rows), "seq": pd.Series([s for s, _ in rows], dtype="int64"), "value": [v for _, v in rows]})

    def _close(self, at: int) -> None:
        for (seq,) in [tuple(k) for k in self.early.keys()]:
            self.early.removeKey((seq,))
        self.place.update((at, True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, closed = self.place.get() if self.place.exists() else (0, False)
        latest = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            latest = max(latest, int(frame["ms"].max()))
            if closed:
                continue
            frame = frame.sort_values(["seq", "ms", "kind", "payload"], na_position="first")
            for seq, kind, payload in zip(frame["seq"], frame["kind"], frame["payload"]):
                if seq >= at and not self.early.containsKey((int(seq),)):
                    self.early.updateValue((int(seq),), (kind or "", None if payload is None or payload != payload else payload))
        out: list[tuple[int, str]] = []
        while not closed and self.early.containsKey((at,)):
            kind, payload = self.early.getValue((at,))
            self.early.removeKey((at,))
            out.append((at, event_line(key[0], at, payload)))
            at += 1
            if kind in (END, ERROR):
                closed = True
                if kind == ERROR:
                    out.append((at, error_line(key[0])))
        if closed:
            self._close(at)
        else:
            self.place.update((at, False))
        # the run is looked at again once nothing has come for the idle time; a closed one is forgotten then
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.idle_ms)
        if out:
            yield self._out(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, closed = self.place.get() if self.place.exists() else (0, True)
        if not closed:
            self._close(at)
            # it stays closed for another idle time, so that stragglers don't begin it anew
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle_ms)
            yield self._out(key[0], [(at, error_line(key[0]))])
        else:
            self.place.clear()

    def close(self) -> None:
        pass


def stream_lines(events: DataFrame, delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """lines() of a stream, in append mode; needs the RocksDB state store.

    A run without an end is given up, with an error line, once the watermark (the latest ts less
    delay) is idle_ms beyond its last event; the state of a run goes then or one idle time later.
    Events without a run, a number or a time are dropped.
    """
    d = events.filter("request_id is not null and seq >= 0 and ts is not null").select(F.col("request_id").cast("string").alias("request_id"), F.col("seq").cast("long").alias("seq"), "kind", "payload", F.col("ts").cast("timestamp").alias("ts"))
    d = d.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return d.groupBy("request_id").transformWithStateInPandas(_Run(idle_ms), outputStructType=LINE, outputMode="append", timeMode="eventTime")
