"""Text functions, memory, evaluation and streams."""

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import evaluation, memory, resolve, retrieval
from evigraph.streaming import sessions


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "query, route",
    [("", "clarify"), ("?", "clarify"), ("这个呢？", "clarify"), ("帮我写一段话", "direct_llm"), ("Barack Obama 和 Michelle Obama 有什么关系？", "kg_rag"), ("who is he", "kg_rag"), ("Alice and Bob", "kg_rag"), ("hello there", "direct_llm"), ("查询关系", "kg_rag")],
)
def test_router(spark, query, route):
    assert one(spark, T.route(F.col("q")), q=query) == route


def test_tokens_with_chinese_pairs(spark):
    assert one(spark, T.tokens(F.col("t"), T.KEYWORD_STOPS), t="The Foo_bar 知识图谱 foo") == ["foo", "bar", "知识图谱", "知识", "识图", "图谱"]


def test_mention(spark):
    assert one(spark, T.mention(F.col("t")), t='  "Barack_ÓBAMA"! ') == "barack obama"


@pytest.mark.parametrize("n, score", [(0, 0.0), (5, 0.45), (20, 0.75), (100, 1.0), (600, 0.75), (1300, 0.55)])
def test_length_score(spark, n, score):
    assert one(spark, T.length_score(F.col("t")), t="x" * n) == score


def test_sensitive(spark):
    assert one(spark, T.sensitive(F.col("t")), t="use sk-abcdefghijklmnop now") and not one(spark, T.sensitive(F.col("t")), t="hello")


def test_metrics(spark):
    assert one(spark, evaluation.exact_match(F.col("a"), F.col("b")), a="Hello, World!", b="hello world")
    assert one(spark, evaluation.contains_match(F.col("a"), F.col("b")), a="Alice works at Example Corp", b="Example Corp")
    assert one(spark, evaluation.keyword_recall(F.col("a"), F.array(F.lit("Alice"), F.lit("Bob"))), a="Alice and Bob") == 1.0
    assert one(spark, evaluation.exact_match(F.col("a"), F.col("b")), a="x", b="") is None


def test_duplicate_cases(spark):
    with pytest.raises(ValueError):
        evaluation.require_unique_cases(spark.createDataFrame([("a",), ("a",)], "case_id string"))


def test_percentiles_interpolate(spark):
    r = evaluation.numeric_summary(spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double"), "x").first()
    assert (r.p50, r.p90, r["count"]) == (2.5, 3.7, 4)


def test_memory_keeps_no_secrets_and_merges(spark):
    m = spark.createDataFrame([(1, "fact", "Likes  tea", 0.5), (1, "fact", "likes tea", 0.9), (1, "fact", "access token = abcdefghijk", 0.9)], "scope long, memory_type string, content string, confidence double")
    got = memory.upsert(m.limit(0), m).collect()
    assert [(r.key, r.confidence, r.n) for r in got] == [("likes tea", 0.9, 2)]


def test_explicit_capture(spark):
    m = spark.createDataFrame([(1, 1, "user", "Remember that I prefer tea"), (1, 2, "user", "do not remember that"), (1, 3, "assistant", "remember that x y")], "session long, turn long, role string, text string")
    assert [(r.content, r.memory_type) for r in memory.explicit_capture(m).collect()] == [("I prefer tea", "preference")]


def test_active(spark):
    m = spark.createDataFrame([("active", None), ("active", "2040-01-01"), ("active", "2020-01-01"), ("active", "never"), ("deleted", None)], "status string, expires_at string")
    assert memory.active(m, "2030-01-01").count() == 2


def test_alias_ties(spark):
    n = spark.createDataFrame([("a", "Same"), ("b", "same")], "node_key string, name string")
    last = {r.alias_key: r.node_key for r in resolve.aliases(n).collect()}
    first = {r.alias_key: r.node_key for r in resolve.aliases(n, True).collect()}
    assert last["same"] == "b" and first["same"] == "a" and last["Same"] == "a"


def test_knn_ties_and_nulls(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id long, v array<double>")
    got = retrieval.knn(v.filter("id = 1"), v, 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (2, 1.0)]


def test_channel_twice_adds_twice(spark):
    h = spark.createDataFrame([(0, 1, "vector", 0.5), (0, 1, "vector", 0.5), (0, 1, "keyword", 1.0)], "query_id long, id long, channel string, score double")
    assert retrieval.merge_channels(h).first().score == pytest.approx(0.7 * 1.08)


def test_stream_windows_equal_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    stream = sessions.tumbling(sessions.read_events(spark, path, schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    batch = sessions.tumbling(spark.read.parquet(f"{path}/events.parquet"))
    assert spark.table("tumbled").count() == batch.count() > 0


def test_rerank_scores_entity_terms(spark):
    """The reference's demonstration: three texts, two entity terms; and terms found in metadata only."""
    query = "阿尔茨海默病和FDG-PET有什么关系"
    texts = ["阿尔茨海默病是一种神经退行性疾病。", "FDG-PET 可以反映脑代谢信息，并常用于阿尔茨海默病相关研究。", "这是一个无关文本。"]
    terms = ["阿尔茨海默病", "FDG-PET"]
    rows = [(0, query, i, t, s, 1, c, terms, None) for i, (t, s, c) in enumerate(zip(texts, (0.72, 0.68, 0.80), ("vector", "vector", "keyword")), 1)]
    rows += [(1, "x", i, "plain words", 0.5, 1, "vector", [" ", "New-York"], m) for i, m in ((1, None), (2, {"name": "new  york city"}))]
    rows += [(2, "x", 1, "plain words", 0.5, 1, "vector", None, None)]
    c = spark.createDataFrame(rows, "query_id int, query string, id int, text string, score double, n_sources int, channel string, e array<string>, m map<string,string>")
    base = {(r["query_id"], r["id"]): r["rerank_score"] for r in retrieval.rerank(c).collect()}
    got = {(r["query_id"], r["id"]): r for r in retrieval.rerank(c, entities="e", metadata="m").collect()}
    assert sorted((r["rank"], i) for (q, i), r in got.items() if q == 0) == [(1, 2), (2, 1), (3, 3)]
    gain = {key: round(r["rerank_score"] - base[key], 6) for key, r in got.items()}
    assert gain == {(0, 1): 0.075, (0, 2): 0.15, (0, 3): 0.0, (1, 1): 0.0, (1, 2): 0.15, (2, 1): 0.0}
    assert base[1, 1] == base[1, 2] and got[1, 2]["rank"] == 1
