"""Evaluation metrics and their summaries; null means that a metric does not apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as T

PUNCTUATION = r"[!-/:-@\[-`{-~。，！？；：、“”‘’（）《》【】]"


def bare(text: Column) -> Column:
    """Normalised text without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(T.plain(text), PUNCTUATION, ""), r"\s+", " "))


def exact_match(answer: Column, reference: Column) -> Column:
    return F.when(F.coalesce(F.trim(reference), F.lit("")) == "", F.lit(None)).otherwise(bare(answer) == bare(reference))


def contains_match(answer: Column, reference: Column) -> Column:
    return F.when(F.coalesce(F.trim(reference), F.lit("")) == "", F.lit(None)).otherwise(F.contains(bare(answer), bare(reference)))


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that the answer holds; null without keywords."""
    body = T.plain(answer)
    hits = F.size(F.filter(keywords, lambda k: F.contains(body, T.plain(k))))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords))


def boolean_summary(records: DataFrame, metric: str) -> DataFrame:
    """total, passed, rate (null without data, at four digits) of a boolean column."""
    n, ok = F.count(metric), F.count_if(F.col(metric))
    return records.agg(n.alias("total"), ok.alias("passed"), F.bround(F.when(n > 0, ok / n), 4).alias("rate"))


def numeric_summary(records: DataFrame, metric: str) -> DataFrame:
    """count, avg, min, max, p50, p90, p95 (interpolated) at four digits; zeros without data."""
    m = F.col(metric).cast("double")
    out = {"avg": F.avg(m), "min": F.min(m), "max": F.max(m), "p50": F.percentile(m, 0.5), "p90": F.percentile(m, 0.9), "p95": F.percentile(m, 0.95)}
    return records.agg(F.count(m).alias("count"), *(F.bround(F.coalesce(v, F.lit(0.0)), 4).alias(k) for k, v in out.items()))


def count_by_key(records: DataFrame, key: str) -> DataFrame:
    """key, n; null counts as the empty key."""
    return records.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def require_unique_cases(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """cases, or an error if a case is named twice."""
    twice = cases.groupBy(key).count().filter("count > 1").select(key).take(1)
    if twice:
        raise ValueError(f"duplicate {key}: {twice[0][0]}")
    return cases


def filter_cases(cases: DataFrame, category: str | None = None, difficulty: str | None = None, expected_route: str | None = None) -> DataFrame:
    """Cases equal in every field that is asked for."""
    for name, value in (("category", category), ("difficulty", difficulty), ("expected_route", expected_route)):
        if value is not None:
            cases = cases.filter(F.col(name) == value)
    return cases


def run_summary(records: DataFrame) -> DataFrame:
    """total, and count and rate (four digits, 0 without records) of errors, answers, evidence and grounded entities.

    records are (has_error, answer, num_evidence, num_grounded_entities); null means no.
    """
    some = {
        "errors": F.coalesce(F.col("has_error"), F.lit(False)),
        "with_answer": F.trim(F.coalesce("answer", F.lit(""))) != "",
        "with_evidence": F.coalesce("num_evidence", F.lit(0)) > 0,
        "with_grounded_entities": F.coalesce("num_grounded_entities", F.lit(0)) > 0,
    }
    total = F.count(F.lit(1))
    counts = [F.count_if(c).alias(f"num_{k}") for k, c in some.items()]
    rates = [F.bround(F.when(total > 0, F.count_if(c) / total).otherwise(0.0), 4).alias(f"{k}_rate") for k, c in some.items()]
    return records.agg(total.alias("total"), *counts, *rates)
