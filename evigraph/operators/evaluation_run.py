"""A whole evaluation: records joined with their cases, and every metric summed up for all and for each group in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import evaluation as V

BOOLEANS = ("has_error", "has_answer", "has_evidence", "has_grounded_entities", "exact_match", "contains_match", "route_match", "answerability_match")
NUMBERS = ("keyword_recall", "latency_ms", "num_evidence", "num_grounded_entities", "num_warnings")
GROUPS = ("category", "difficulty", "route", "answerability")
# What a case without a category or a difficulty counts as.
CATEGORY, DIFFICULTY = "general", "normal"


def _match(expected: Column, found: Column) -> Column:
    """Whether a label is the expected one, after normalising; null where none is expected."""
    return F.when(T.plain(expected) != "", T.plain(expected) == T.plain(found))


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that say something which the answer holds, without punctuation; 0 without any."""
    body = V.bare(answer)
    asked = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), V.bare), lambda k: k != "")
    return F.when((body == "") | (F.size(asked) == 0), 0.0).otherwise(F.size(F.filter(asked, lambda k: F.contains(body, k))) / F.size(asked))


def attach(records: DataFrame, cases: DataFrame) -> DataFrame:
    """Every record (case_id, answer, route, answerability, has_error, latency_ms, num_evidence, num_grounded_entities, num_warnings) with its case and metrics.

    cases: case_id, reference_answer, keywords, expected_route, expected_answerability, category,
    difficulty, each named once (evaluation.require_unique_cases). A metric is null where the case
    expects nothing of it; a record of no case expects nothing and counts as general and normal.
    """
    c = cases.select(F.col("case_id").alias("_case"), *(F.col(n).alias(f"_{n}") for n in ("reference_answer", "keywords", "expected_route", "expected_answerability", "category", "difficulty")))
    d = records.join(c, F.col("case_id") == F.col("_case"), "left")
    answer, reference = F.col("answer"), F.col("_reference_answer")
    has_reference = T.plain(reference) != ""
    said, wanted = V.bare(answer), V.bare(reference)
    named = lambda c, other: F.coalesce(F.nullif(T.strip(F.col(c)), F.lit("")), F.lit(other))
    return d.select(
        *records.columns,
        named("_category", CATEGORY).alias("category"), named("_difficulty", DIFFICULTY).alias("difficulty"), has_reference.alias("has_reference"),
        F.when(has_reference, (said != "") & (wanted != "") & (said == wanted)).alias("exact_match"), F.when(has_reference, (said != "") & (wanted != "") & F.contains(said, wanted)).alias("contains_match"),
        keyword_recall(answer, F.col("_keywords")).alias("keyword_recall"), _match(F.col("_expected_route"), F.col("route")).alias("route_match"), _match(F.col("_expected_answerability"), F.col("answerability")).alias("answerability_match"),
        (T.strip(answer) != "").alias("has_answer"), (F.coalesce("num_evidence", F.lit(0)) > 0).alias("has_evidence"), (F.coalesce("num_grounded_entities", F.lit(0)) > 0).alias("has_grounded_entities"),
    )


def summarize(attached: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """group_by, group, metric, n, hit, avg, min, max, p50, p90, p95: every metric over all records and over each group.

    n counts values that are not null. For metrics that are true or false, avg is the rate (null
    without values) and only hit and avg are given; for numbers hit is null and the rest is 0
    without values. Figures have four digits. A null group counts as the empty one. Records are read
    once: metrics become rows, which grouping sets sum up, partly before they are shuffled.
    """
    cast = lambda c: F.col(c).cast("double") if c in attached.columns else F.lit(None).cast("double")
    error = F.coalesce(F.col("has_error"), F.lit(False)).cast("double")
    values = [F.struct(F.lit(m).alias("metric"), F.lit(True).alias("logical"), (error if m == "has_error" else cast(m)).alias("v")) for m in BOOLEANS]
    values += [F.struct(F.lit(m).alias("metric"), F.lit(False).alias("logical"), cast(m).alias("v")) for m in NUMBERS]
    held = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in groups]
    rows = attached.select(*held, F.inline(F.array(*values)))
    always = [F.col("metric"), F.col("logical")]
    sets = [always, *([*always, F.col(g)] for g in groups)]
    told = lambda x: F.bround(F.coalesce(x, F.lit(0.0)), 4)
    marks = [F.grouping(g).alias(f"_{g}") for g in groups]
    p = F.percentile("v", F.array(*map(F.lit, (0.5, 0.9, 0.95))))
    out = rows.groupingSets(sets, "metric", "logical", *groups).agg(F.count("v").alias("n"), F.sum("v").alias("hit"), F.avg("v").alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"), p.alias("p"), *marks)
    name, value = F.lit("all"), F.lit("")
    for g in groups:
        name, value = F.when(F.col(f"_{g}") == 0, g).otherwise(name), F.when(F.col(f"_{g}") == 0, F.col(g)).otherwise(value)
    number = lambda x: F.when(~F.col("logical"), told(x))
    return out.select(
        name.alias("group_by"), value.alias("group"), "metric", "n", F.when(F.col("logical"), F.coalesce("hit", F.lit(0.0)).cast("long")).alias("hit"), F.when(F.col("logical"), F.bround("avg", 4)).otherwise(told(F.col("avg"))).alias("avg"),
        number(F.col("min")).alias("min"), number(F.col("max")).alias("max"), *(number(F.get("p", k)).alias(n) for k, n in enumerate(("p50", "p90", "p95"))),
    )
