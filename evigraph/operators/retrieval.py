"""Vector, keyword and hybrid retrieval and re-ranking; queries and corpora are tables."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.sources.workspace import folder

#: Vectors and queries that one task multiplies, and queries that it ranks at a time.
BLOCK, RANKED = 4000, 250
#: Queries, and tokens of queries, that a worker holds for keyword search; more are matched in blocks, one pass over the texts a block.
QUERY_BLOCK, BLOCK_TOKENS = 2000, 200_000
#: Words, runs of Chinese characters and runs of blanks, as functions.text has them.
ASCII_WORD, CJK_RUN, BLANK_RUN = re.compile(r"[a-zA-Z0-9_]+"), re.compile(f"[{T.CJK}]+"), re.compile(r"\s+", re.ASCII)
CHANNEL_WEIGHTS = {"vector": 0.60, "entity": 0.30, "keyword": 0.10}
UNKNOWN_WEIGHT, SOURCE_BONUS = 0.20, 0.08
CROSS_WEIGHT = 0.65
RERANK_WEIGHTS = {"base": 0.45, "overlap": 0.25, "entity": 0.15, "source": 0.10, "length": 0.05}


def _matrix(v: pa.ListArray) -> np.ndarray:
    """Rows of lists of numbers, shorter ones filled with zeros."""
    sizes = np.diff(v.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return out


def _top(k: int, metric: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_query = table.column("q").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        x = _matrix(table.column("v").combine_chunks())
        a, b, qi, vi = x[is_query], x[~is_query], ids[is_query], ids[~is_query]
        if not len(qi) or not len(vi):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        nb = np.linalg.norm(b, axis=1) if metric == "cosine" else (b * b).sum(axis=1)
        best, near = [], []
        for at in range(0, len(qi), RANKED):
            some = a[at : at + RANKED]
            d = some @ b.T
            if metric == "cosine":
                na = np.linalg.norm(some, axis=1, keepdims=True)
                d = 1 - d / np.where(na == 0, 1, na) / np.where(nb == 0, 1, nb)
            else:
                d = np.maximum((some * some).sum(axis=1)[:, None] + nb[None] - 2 * d, 0)
            d = np.round(d, 9) + 0.0
            order = np.lexsort((np.broadcast_to(vi, d.shape), d), axis=1)[:, :k]
            best.append(vi[order])
            near.append(np.take_along_axis(d, order, axis=1))
        ids, distances = np.concatenate(best), np.concatenate(near)
        return pa.table({"query_id": np.repeat(qi, ids.shape[1]), "id": ids.ravel(), "distance": distances.ravel()})

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    """The k nearest vectors (id, v) of every query (id, v): query_id, id, distance, score = 1 - distance in [0, 1], rank.

    Blocks of queries meet blocks of vectors; each pair of blocks keeps k a query, so no task holds
    more than two blocks. Distances are compared at nine digits; ties go to the smaller id. Vectors
    that are null or hold null or non-finite numbers are left out, as are rows without an id; of two
    vectors of different lengths, the shorter one counts as filled with zeros. A vector of zeros has
    the cosine 0 with all.
    """
    n, m = max(1, -(-queries.count() // BLOCK)), max(1, -(-vectors.count() // BLOCK))
    usable = "id is not null and v is not null and forall(v, x -> x is not null and abs(x) < double('infinity'))"
    q = queries.filter(usable).select(F.lit(True).alias("q"), "id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("vb"))
    v = vectors.filter(usable).select(F.lit(False).alias("q"), "id", "v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias("vb"))
    part = q.unionByName(v).groupBy("qb", "vb").applyInArrow(_top(k, metric), "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("score", T.clip(1 - F.col("distance")))


def hash_embedding(docs: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """Sparse hashed bags of words of unit length: key, idx, value. A token's md5 gives its place and sign."""
    if dim < 8:
        raise ValueError("dim must be at least 8")
    token = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1)))
    counted = docs.select(key, token.alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    place = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(F.md5("token"), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    cells = counted.groupBy(key, place.alias("idx")).agg(F.sum(sign * F.col("n")).alias("s")).filter("s <> 0")
    norm = cells.groupBy(key).agg(F.sqrt(F.sum((F.col("s") * F.col("s")).cast("double"))).alias("norm"))
    return cells.join(norm, key).select(key, F.col("idx").cast("int").alias("idx"), (F.col("s") / F.col("norm")).alias("value"))


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """token, number of texts that have it, over keyword tokens."""
    return docs.select(key, F.explode(T.tokens(F.col(text), T.KEYWORD_STOPS)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


class _Keywords:
    """The tokens of a block of queries, which of them a text holds, and the k best texts of each query so far."""

    def __init__(self, queries: list[tuple[int, list[str]]], k: int):
        self.k, self.ids = k, np.array([q for q, _ in queries], np.int64)
        self.sizes = np.array([len(t) for _, t in queries], np.int64)
        self.phrases = [" ".join(t) for _, t in queries]
        self.number: dict[str, int] = {}
        posts: list[list[int]] = []
        for q, (_, tokens) in enumerate(queries):
            for t in tokens:
                n = self.number.setdefault(t, len(self.number))
                if n == len(posts):
                    posts.append([])
                posts[n].append(q)
        #: Queries that have each token.
        self.posts = [np.array(p, np.int64) for p in posts]
        self.stops = frozenset(T.KEYWORD_STOPS)
        #: Finds all tokens inside a text in one pass.
        self.finder = ahocorasick.Automaton()
        for t, n in self.number.items():
            self.finder.add_word(t, n)
        self.finder.make_automaton()
        #: The most that tokens inside words can score.
        self.inner = np.round(np.minimum(0.25 + 0.1 * self.sizes, 1.0), 9)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries]
        #: Score and id of each query's k-th text, which others must beat.
        self.least, self.last = np.zeros(len(queries)), np.full(len(queries), np.iinfo(np.int64).min)

    def beats(self, scores: np.ndarray | float, key: int) -> np.ndarray:
        """For each query, whether a text of such a score and this id would be among the k best so far."""
        return (scores > self.least) | ((scores == self.least) & (key < self.last))

    def count(self, tokens) -> np.ndarray:
        """For each query, how many of these tokens it has."""
        posts = [self.posts[k] for k in tokens]
        return np.bincount(np.concatenate(posts), minlength=len(self.ids)) if posts else np.zeros(len(self.ids), np.int64)

    def parts(self, words: set[str]) -> np.ndarray:
        """For each query, how many of its tokens are words or parts of words; tokens hold no other characters than words do."""
        return self.count({k for _, k in self.finder.iter(" ".join(words))})

    def read(self, key: int, low: str) -> None:
        """Score a text in lower case for the queries whose k best it can enter; the formula is that of functions.text.keyword_score."""
        if not self.beats(1.0, key).any():
            return
        text = low.replace("_", " ").replace("-", " ")
        words = set(ASCII_WORD.findall(text))
        if not text.isascii():
            runs = CJK_RUN.findall(text)
            words.update(runs, (r[i : i + 2] for r in runs if len(r) >= 4 for i in range(len(r) - 1)))
        own = len(words) - len(words & self.stops)
        if not own:
            return
        size = np.maximum(self.sizes, 1)
        both = self.count([k for w in words - self.stops if (k := self.number.get(w)) is not None])
        # the bound of a query is its score with the whole phrase
        bound = np.where(both > 0, np.round(np.minimum(0.65 * both / size + 0.25 * both / own + 0.10, 1.0), 9), self.inner)
        can = self.beats(bound, key)
        exact, inner = np.flatnonzero(can & (both > 0)), np.flatnonzero(can & (both == 0))
        if len(exact):
            phrase = np.zeros(len(exact))
            # all words of a phrase but the first and the last stand in the text as they are
            near = np.flatnonzero(both[exact] >= self.sizes[exact] - 2)
            if len(near):
                body = BLANK_RUN.sub(" ", text).strip(" ")
                phrase[near] = [0.10 if self.phrases[q] in body else 0.0 for q in exact[near]]
            self.keep(exact, np.minimum(0.65 * both[exact] / size[exact] + 0.25 * both[exact] / own + phrase, 1.0), key)
        if len(inner):
            parts = self.parts(words)[inner]
            self.keep(inner, np.where(parts > 0, np.minimum(0.25 + 0.1 * parts, 1.0), 0.0), key)

    def keep(self, at: np.ndarray, scores: np.ndarray, key: int) -> None:
        """Let a text with these scores into the k best of queries, where it is one of them."""
        for q, s in zip(at.tolist(), np.round(scores, 9).tolist()):
            heap, entry = self.heaps[q], (s, -key)
            if s <= 0:
                continue
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[q], self.last[q] = heap[0][0], -heap[0][1]


def _keyword_top(queries: list[tuple[int, list[str]]], k: int):
    """(id, low) to the k best texts of each query among those of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Keywords(queries, k)
        for batch in batches if queries else ():
            for key, low in zip(batch.column(0).to_pylist(), batch.column(1)):
                index.read(key, low.as_py())
        rows = [(q, -i, s) for q, heap in zip(index.ids.tolist(), index.heaps) for s, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    return run


def keyword_search(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank: the k best texts (id, text) of every query (query_id, query) by keyword score over 0.

    Queries are held in blocks of about QUERY_BLOCK queries and BLOCK_TOKENS tokens, as an index from tokens to queries;
    of several blocks one at a time is brought to the tasks, and what it found is written before the next. Texts are read
    once a block. Each task keeps k texts a query; a text is scored only for queries whose k-th text its bound beats, and
    is not even split into words where no score would do. Null texts and queries without tokens find nothing; rows
    without an id are left out; ties go to the smaller id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), T.tokens(F.col("query"), T.KEYWORD_STOPS).alias("t")).filter("query_id is not null and size(t) > 0")
    n = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("t")).first()
    blocks = max(1, -(-n["n"] // QUERY_BLOCK), -(-n["t"] // BLOCK_TOKENS))
    rows = docs.filter("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), F.lower("text").alias("low"))
    at = None if blocks == 1 else folder(queries.sparkSession, "keywords")
    for b in range(blocks):
        held = [(r["query_id"], r["t"]) for r in asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).sort("query_id", "t").collect()]
        found = rows.mapInArrow(_keyword_top(held, k), "query_id long, id long, score double")
        if at:
            found.write.parquet(f"{at}/block={b}")
    if at:
        found = queries.sparkSession.read.schema(found.schema).parquet(*(f"{at}/block={b}" for b in range(blocks)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights must be finite and not negative, and one of them positive; they are not rescaled."""
    if any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    if not any(w > 0 for w in weights.values()):
        raise ValueError("at least one weight must be positive")
    return weights


def merge_channels(hits: DataFrame, k: int = 10, min_score: float = 0.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Merge hits (query_id, id, channel, score) of several channels: weighted sum, more for several channels, in [0, 1].

    A channel that returns an id twice adds twice. Columns: query_id, id, score, n_sources, rank, channel (the first by
    name), raw_scores (each channel's best).
    """
    weight = F.lit(UNKNOWN_WEIGHT)
    for channel, w in check_weights(CHANNEL_WEIGHTS if weights is None else weights).items():
        weight = F.when(F.col("channel") == channel, w).otherwise(weight)
    each = hits.groupBy("query_id", "id", "channel").agg(F.sum("score").alias("sum"), F.max("score").alias("best"))
    out = each.groupBy("query_id", "id").agg(
        F.sum(F.col("sum") * weight).alias("raw"), F.count("channel").alias("n_sources"), F.min("channel").alias("channel"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "best")))).alias("raw_scores")
    )
    out = out.withColumn("score", F.round(T.clip(F.col("raw") * (1 + SOURCE_BONUS * (F.col("n_sources") - 1))), 9))
    out = out.filter(F.col("score") >= min_score) if min_score > 0 else out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score", "n_sources", "rank", "channel", "raw_scores")


def hybrid(channels: dict[str, DataFrame], k: int = 10, min_score: float = 0.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Hits (query_id, id, score) of each named channel, merged; a channel without hits changes nothing."""
    parts = [hits.select("query_id", "id", F.lit(name).alias("channel"), F.col("score").cast("double").alias("score")) for name, hits in channels.items()]
    if not parts:
        raise ValueError("no channel to search")
    return merge_channels(reduce(DataFrame.unionByName, parts).filter("query_id is not null and id is not null"), k, min_score, weights)


def retrieve_and_rerank(queries: DataFrame, texts: DataFrame, channels: dict[str, DataFrame], k: int = 10, top: int = 8, min_score: float = 0.0) -> DataFrame:
    """Hybrid retrieval of k hits, then re-ranking to the top ones: queries (query_id, query), texts (id, text)."""
    hits = hybrid(channels, k, min_score).drop("rank").join(queries.select("query_id", "query"), "query_id").join(texts.select("id", "text"), "id")
    return rerank(hits, top)


def rerank(candidates: DataFrame, k: int = 8, entities: str | None = None, metadata: str | None = None) -> DataFrame:
    """Re-rank candidates (query_id, query, id, text, score, n_sources, channel) by rules: query_id, id, rerank_score, rank.

    entities names a column of the query's entity terms (array of strings), metadata one of a
    candidate's metadata (map of strings), in whose values terms are looked up too.
    """
    # behind a generator, so that tokens are taken once a row and not at each mention
    once = F.explode(F.array(F.struct(T.tokens(F.col("query"), T.RERANK_STOPS).alias("q"), T.tokens(F.col("text"), T.RERANK_STOPS).alias("t"), T.light(F.col("text")).alias("body"))))
    candidates = candidates.withColumn("_once", once)
    q, t, body = (F.col("_once")[c] for c in ("q", "t", "body"))
    source = F.when(F.col("n_sources") >= 2, 1.0).when(F.col("channel") == "entity", 0.9).when(F.col("channel") == "vector", 0.8).when(F.col("channel") == "keyword", 0.65).otherwise(0.5)
    w = RERANK_WEIGHTS
    more = F.concat_ws(" ", F.map_values(metadata)) if metadata else F.lit("")
    entity = T.entity_score(F.col(entities), F.col("text"), more) if entities else F.lit(0.0)
    total = w["base"] * T.clip(F.col("score")) + w["overlap"] * T.overlap_score(q, t, body) + w["entity"] * entity + w["source"] * source + w["length"] * T.length_score(F.col("text"))
    out = candidates.select("query_id", "id", F.round(T.clip(total), 9).alias("rerank_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def min_max(df: DataFrame, score: str) -> DataFrame:
    """score scaled by its least and greatest value in each query; 0.5 where these are equal."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("scaled", F.when(hi == lo, 0.5).otherwise((F.col(score) - lo) / (hi - lo)))


def blend(ranked: DataFrame, cross: str, rule: str = "rerank_score", k: int = 8) -> DataFrame:
    """Re-rank by a cross-encoder's given scores, scaled in each query, and the rules' score: query_id, id, blended, rank."""
    total = F.round(CROSS_WEIGHT * F.col("scaled") + (1 - CROSS_WEIGHT) * F.col(rule), 9)
    out = min_max(ranked, cross).select("query_id", "id", total.alias("blended"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("blended"), "id"))).filter(F.col("rank") <= k)
