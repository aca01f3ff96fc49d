"""The events table as runs of users: lines of JSON and appended lists, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from evigraph.sources.graph_tables import table
from evigraph.streaming import runs as R


def _runs(spark, sf_dir):
    """A user's events in order of time as one run; purchases end a run, errors fail it, every 17th event is lost, every fifth comes twice."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(order) - 1)
    kind = F.when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "error", "error").otherwise("step")
    payload = F.concat(F.lit('{"Config": {"k": 1}, "body": '), "props", F.lit(', "deep": [{"graph_store": [1], "type": "'), "event_type", F.lit('"}], "traces": ["'), "event_type", F.lit('", '), "event_id", F.lit('], "warnings": 3}'))
    d = e.filter("event_id % 17 <> 0").select(F.concat(F.lit("u"), "user_id").alias("request_id"), "seq", kind.alias("kind"), payload.alias("payload"), F.col("ts").cast("timestamp").alias("ts"))
    return d.unionByName(d.filter("seq % 5 = 0").withColumns({"payload": F.lit("[]"), "ts": F.col("ts") + F.expr("INTERVAL 1 DAY")}))


def ev_run_lines(spark, sf_dir):
    return R.lines(_runs(spark, sf_dir))


def ev_appended_lists(spark, sf_dir):
    return R.appended(_runs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (ev_run_lines, ev_appended_lists)}
_E = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
    d AS (SELECT 'u' || user_id AS request_id, seq, event_type, event_id, props FROM e WHERE event_id % 17 <> 0)"""
ORACLES = {
    "ev_run_lines": f"""WITH {_E}, p AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(sum((event_type IN ('purchase', 'error'))::INT) OVER (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed
            FROM d WINDOW w AS (PARTITION BY request_id ORDER BY seq)),
        k AS (SELECT * FROM p WHERE place = seq AND closed = 0),
        f AS (SELECT request_id, (SELECT coalesce(max(seq), -1) + 1 FROM k WHERE k.request_id = r.request_id) AS seq FROM (SELECT DISTINCT request_id FROM d) r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.request_id = r.request_id AND event_type = 'purchase'))
        SELECT request_id, seq, '{{"request_id": "' || request_id || '", "seq": ' || seq || ', "event": {{"Config": "[redacted]", "body": ' || props || ', "deep": [{{"graph_store": "[redacted]", "type": "' || event_type || '"}}], "traces": ["' || event_type || '", ' || event_id || '], "warnings": 3}}}}' AS value FROM k
        UNION ALL SELECT request_id, seq, '{{"request_id": "' || request_id || '", "error": {{"error_code": "stream_execution_failed", "message": "The stream terminated unexpectedly."}}}}' FROM f""",
    "ev_appended_lists": f"""WITH {_E} SELECT request_id, 'traces' AS name, 2 * (row_number() OVER (PARTITION BY request_id ORDER BY seq) - 1) AS position, '"' || event_type || '"' AS item FROM d
        UNION ALL SELECT request_id, 'traces', 2 * (row_number() OVER (PARTITION BY request_id ORDER BY seq) - 1) + 1, event_id::VARCHAR FROM d""",
}
