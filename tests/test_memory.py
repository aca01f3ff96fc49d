"""Which candidates are written, and texts cut to a budget of tokens."""

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import memory as M
from tests.test_functions import one

CANDIDATE = "scope long, ord int, user_id string, memory_type string, content string, confidence double"


def test_screen(spark):
    rows = [(1, 1, "u", "fact", "ok", 0.5), (1, 2, " ", "fact", "x", 0.5), (1, 3, "u", "rumour", "x", 0.5), (1, 4, "u", None, "x", 0.5), (1, 5, "u", "note", "password: hunter2", 0.5)]
    rows += [(1, 6, "u", "note", "x", 0.0), (1, 7, "u", "note", None, None), (1, 8, "u", "task", "", 1.0), (1, 9, "u", "task", "late", 1.0), (2, 9, None, "task", "x", 1.0)]
    d = spark.createDataFrame(rows, CANDIDATE)
    got = [r["reason"] for r in M.screen(d).orderBy("scope", "ord").collect()]
    assert got == [None, "missing_user_id", "memory_type_not_allowed", "memory_type_not_allowed", "sensitive_content", "invalid_confidence", "invalid_confidence", None, "write_candidate_budget", "missing_user_id"]
    assert M.screen(d.filter("scope = 2"), need_user=False).first()["reason"] is None and M.screen(d.limit(0)).isEmpty()


@pytest.mark.parametrize("text, budget, want", [("abcdefgh", 2, "abcdefgh"), ("abcdefghijklm", 2, "abcdefghijk"), ("abcdefg    xyz", 2, "abcdefg"), ("姚明姚明", 1, "姚明"), ("😀😀😀", 1, "😀😀"), ("abc", 0, ""), ("", 5, ""), (None, 5, "")])
def test_trim_tokens(spark, text, budget, want):
    assert one(spark, T.trim_tokens(F.col("t"), budget), t=text) == want
