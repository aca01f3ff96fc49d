"""Files of an evaluation run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from evigraph.operators.evaluation import run_summary
from evigraph.sources.readers import event_lines, write_json

#: Files that a report has, each a folder of parts written by Spark.
PARTS = ("manifest.json", "summary.json", "records.jsonl", "errors.jsonl", "report.md", "records.csv")


def _cell(field: t.StructField) -> Column:
    """Lists, maps and structures as JSON, as CSV has no such values."""
    nested = isinstance(field.dataType, (t.ArrayType, t.MapType, t.StructType))
    return F.to_json(field.name).alias(field.name) if nested else F.col(field.name)


def markdown(summary: DataFrame) -> DataFrame:
    """value: the one row of a summary as a table of names and values; nulls read n/a."""
    rows = F.array(*(F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("n/a")), F.lit(" |")) for c in summary.columns))
    return summary.select(F.array_join(F.concat(F.array(*map(F.lit, ("# Evaluation report", "", "| Metric | Value |", "|---|---|"))), rows), "\n").alias("value"))


def write_report(spark: SparkSession, records: DataFrame, folder: str, run_id: str, written_at: dt.datetime | None = None) -> None:
    """Write PARTS below a folder: the records, those with an error (boolean column has_error), their summary as JSON and as a table, and what was written when.

    records has the columns of evaluation.run_summary and any others. An empty table gives an empty report.
    """
    summary = run_summary(records)
    write_json(summary, f"{folder}/summary.json")
    event_lines(records).write.mode("overwrite").text(f"{folder}/records.jsonl")
    event_lines(records.filter(F.coalesce("has_error", F.lit(False)))).write.mode("overwrite").text(f"{folder}/errors.jsonl")
    records.select(*map(_cell, records.schema.fields)).write.mode("overwrite").csv(f"{folder}/records.csv", header=True)
    markdown(summary).write.mode("overwrite").text(f"{folder}/report.md")
    at = written_at or dt.datetime.now(dt.timezone.utc)
    write_json(spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(at.isoformat()).alias("written_at"), F.array(*map(F.lit, PARTS)).alias("files")), f"{folder}/manifest.json")
