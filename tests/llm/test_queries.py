"""The registered queries against their SQL or brute force, and the pipeline's stages, on the smallest tables."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from evigraph.llm import decontamination, queries

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(cols, want.fetchall())


def test_sharding_query(spark, duck):
    text = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = queries.op4_rendezvous_sharding(spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key") and r["grown_shard"] in (r["shard"], 16)


def test_bpe_query_equals_the_library(spark, duck):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    text = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op5_prefix_bpe(spark, SF).collect():
        ids = own.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() and r["round_trip"]


def _distance(item, text):
    """Edit distance to the nearest passage, by the whole table."""
    prev = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        cur = np.empty_like(prev)
        cur[0] = i
        for j, d in enumerate(text, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != d))
        prev = cur
    return int(prev.min())


def test_myers_equals_the_whole_table():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item = "".join(rng.choice(list("abc "), rng.integers(1, 30)))
        text = "".join(rng.choice(list("abc "), rng.integers(0, 60)))
        hit = decontamination.myers(item, text, len(item))
        assert (hit[0] if hit else len(item)) == _distance(item, text)


def test_decontamination_query_finds_all_whole_items(spark, duck):
    norm = decontamination.normalise
    docs, items = (duck.execute(f"SELECT * FROM {t}").fetchall() for t in ("documents", "benchmark"))
    want = {(d[0], i[0]) for d in docs for i in items if norm(i[1]) in norm(d[1])}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_pigeonhole_decontamination(spark, SF).collect() if r["distance"] == 0}
    assert got == want and want


def test_held_out_languages(spark, duck):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in queries.op6_bigru_language_id(spark, SF).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def _sets(rows, width):
    out = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        out[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    return out


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs_in, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept.append((docs_in, docs))
        if k < 4:
            assert docs.columns == docs_in.columns
    text = lambda d: {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    before, after = text(kept[1][0]), text(kept[1][1])
    sets = _sets(before.items(), corpus_pipeline.WIDTH)
    near = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.PERCENT * len(sets[a] | sets[b])
    ids = sorted(before)
    group = {k: k for k in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if near(a, b) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    assert set(after) == set(group.values())
    items = [decontamination.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {k for k, t in text(kept[2][0]).items() if any(i in decontamination.normalise(t) for i in items)}
    assert leaked and set(text(kept[2][1])) == set(text(kept[2][0])) - leaked
    assert set(text(kept[3][1])) == set(text(kept[3][0]))
    assert not any(re.search(r"[0-9a-f]{32}", t) for t in text(kept[3][1]).values())
    assert kept[4][1].filter("not round_trip").count() == 0 and kept[4][1].count() == kept[4][0].count()
