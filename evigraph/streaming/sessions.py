"""Streams of events and messages: windows over late data, and a keyed buffer of recent messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, glob: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def timed(events: DataFrame) -> DataFrame:
    """events with ts as a timestamp in UTC, which windows and watermarks ask for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total over windows of one width; rows later than delay are dropped in a stream."""
    e = timed(events)
    e = e.withWatermark("ts", delay) if e.isStreaming else e
    out = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n: events of one user with less than gap between neighbours."""
    e = timed(events)
    e = e.withWatermark("ts", delay) if e.isStreaming else e
    out = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def recent_buffer(messages: DataFrame, keep: int = 20, timeout_ms: int = 3_600_000) -> DataFrame:
    """After each batch, the last messages (session, turn, text) of the sessions that got any; idle sessions are forgotten."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            held += [(int(t), x) for t, x in zip(frame["turn"], frame["text"]) if isinstance(x, str) and x.strip() and t == t]
        held = sorted(set(held))[-keep:]
        state.update(([t for t, _ in held], [x for _, x in held]))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"session": [key[0]], "n": [len(held)], "last_turn": [held[-1][0] if held else -1]})

    return messages.groupBy("session").applyInPandasWithState(update, "session long, n int, last_turn long", "turns array<long>, texts array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)
