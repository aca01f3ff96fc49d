"""Packing into budgets against a plain loop, summaries after summaries, contexts within their tenant."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import context as C

AS_OF = "2030-01-01 00:00:00"


def _spent(t):
    a = sum(ord(c) < 128 for c in t)
    return int(a / 4 + (len(t) - a) / 1.5)


def _cut(t, budget):
    if _spent(t) <= budget:
        return t
    n = max(i for i in range(len(t) + 1) if _spent(t[:i]) <= budget)
    return t[:n].rstrip()


@pytest.mark.parametrize("budget", [0, 1, 7, 40, 10_000])
def test_pack_equals_a_loop(spark, budget):
    rng = random.Random(budget)
    groups = {g: ["".join(rng.choice(["a", "é", "中", " ", "\n", "xyz ", "😀"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))] for g in range(40)}
    groups[99] = [None, ""]
    rows = [(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    got = {r["g"]: r for r in C.pack(spark.createDataFrame(rows, "g long, ord int, text string").repartition(3), "g", ["ord"], budget).collect()}
    assert set(got) == set(groups)
    for g, ts in groups.items():
        want = _cut("".join(t or "" for t in ts), budget) if budget else ""
        assert got[g]["text"] == want
        assert got[g]["estimated_tokens"] == (max(1, _spent(want)) if want else 0) and (budget == 0 or got[g]["estimated_tokens"] <= budget)


def test_pack_of_nothing(spark):
    assert C.pack(spark.createDataFrame([], "g long, ord int, text string"), "g", ["ord"], 9).collect() == []


def test_summary_after_a_summary(spark):
    m = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f" line {i}\n") for i in range(15)] + [(2, 0, "system", "x" * 2000), (3, 0, "user", " \t")], "session long, turn long, role string, text string")
    old = spark.createDataFrame([(1, " so far "), (2, " "), (3, "kept as it is"), (4, None)], "session long, summary string")
    got = {r["session"]: r["summary"] for r in C.summarize(m, old).collect()}
    lines = "".join(f"\n- {'用户' if i % 2 else '助手'}: line {i}" for i in range(3, 15))
    assert got == {1: "已有上下文：\nso far\n最近对话要点：" + lines, 2: "最近对话要点：\n- system: " + _cut("x" * 2000, 180), 3: "kept as it is", 4: ""}
    assert {r["session"] for r in C.summarize(m).collect()} == {1, 2}


def test_session_keys_keep_tenants_apart(spark):
    rows = [("a", "b", "s"), ("a|1:b", "", "s"), (None, " ", " s "), ("u", "p", " ")]
    d = spark.createDataFrame(rows, "u string, p string, s string").select(C.session_key(F.col("u"), F.col("p"), F.col("s")).alias("k"))
    assert [r["k"] for r in d.collect()] == ["1:a|1:b|1:s", "5:a|1:b|11:__default__|1:s", "13:__anonymous__|11:__default__|1:s", None]


@pytest.mark.parametrize(
    "query, content, want",
    [("", "x", 0.35), ("Tea ", "likes tea", 1.0), ("I like tea very much", "tea", 1.0), ("green tea", "tea is hot", 0.25), ("茶 好", "好 水", 1 / 3), ("!", "x", 0.0), (None, None, 0.35)],
)
def test_lexical_part(spark, query, content, want):
    d = spark.createDataFrame([(query, content, 0.0, "never")], "q string, c string, f double, t string")
    got = d.select(C.relevance(F.col("q"), F.col("c"), F.col("f"), F.col("t"), F.lit(AS_OF).cast("timestamp"))).first()[0]
    assert got == pytest.approx(0.72 * want)


def _memory(i, user="a", project="p", session="", content="answers are in Chinese", kind="project", status="active", expires=None, day=1):
    return (i, "kg:" + project, user, project, session, status, expires, content, kind, 1.0, f"2029-01-{day:02} 00:00:00")


MEMORY = "memory_id string, namespace string, user_id string, project_id string, session_id string, status string, expires_at string, content string, memory_type string, confidence double, updated_at string"
REQUEST = "query_id int, session string, query string, namespace string, user_id string, project_id string, session_id string"


def test_context_stays_within_its_tenant(spark):
    memories = spark.createDataFrame(
        [_memory("m1"), _memory("m2", user="b"), _memory("m3", session="other"), _memory("m4", status="superseded"), _memory("m5", expires="2029-02-01"), _memory("m6", content="nothing near", kind="note", day=2)], MEMORY
    )
    messages = spark.createDataFrame([("a|p|s", 0, "user", "this is s"), ("a|p|s", 1, None, " an answer "), ("a|p|s", 2, "user", " ")], "session string, turn int, role string, text string")
    summaries = spark.createDataFrame([("a|p|s", " earlier\n"), ("a|q|s", " ")], "session string, summary string")
    ask = lambda i, user, project, session: (i, f"{user}|{project}|{session}", "are answers in Chinese", "kg:" + project, user, project, session)
    requests = spark.createDataFrame([ask(1, "a", "p", "s"), ask(2, "a", "q", "s"), ask(3, "c", "p", "s"), ask(4, "a", "p", "t"), (5, None, "x", "kg:p", "a", "p", "")], REQUEST)
    got = {r["query_id"]: r for r in C.load(requests, messages, summaries, memories, AS_OF).collect()}
    found = C.retrieve_for(requests.filter("query_id = 1"), memories, AS_OF).collect()
    assert [r["memory_id"] for r in found] == ["m1", "m6"]
    lines = "".join(f"\n- ({r['memory_type']}, {r['score']:.3f}) {r['content']}" for r in found)
    assert got[1]["text"] == "[会话摘要]\nearlier\n\n[相关长期记忆]" + lines + "\n\n[最近对话]\n- user: this is s\n- unknown: an answer"
    assert (got[1]["n_memories"], got[1]["n_recent"]) == (2, 2)
    assert [got[i]["text"] for i in (2, 3)] == ["", ""] and got[2]["estimated_tokens"] == 0
    assert got[4]["text"].startswith("[相关长期记忆]") and "[最近对话]" not in got[4]["text"]
    assert got[5]["n_recent"] == 0 and got[5]["n_memories"] == 3  # no session asked for: those of every session are seen
    assert [r["memory_id"] for r in C.retrieve_for(requests.filter("query_id = 1"), memories, AS_OF, types=["note"]).collect()] == ["m6"]
    assert C.retrieve_for(requests, memories.limit(0), AS_OF).isEmpty() and C.load(requests.limit(0), messages, summaries, memories, AS_OF).isEmpty()


@pytest.mark.parametrize("text, secret", [("api key = x1", True), ("access_token: y", True), ("my token = z", False), ("mysecret=1", False), ("sk-abcdefghijkl", True), ("sk-abcdefghij", False), ("Bearer abcdefghijkl", True), ("bearer short", False)])
def test_secrets_by_the_fixed_patterns(spark, text, secret):
    assert spark.createDataFrame([(text,)], "t string").select(T.sensitive(F.col("t"))).first()[0] == secret
