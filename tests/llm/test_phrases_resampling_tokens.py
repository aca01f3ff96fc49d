"""Operators 11 to 13 against plain loops and the library, on odd inputs and with tiny slices, shards and ranges."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm import collocations, queries, rans, resampling, spans, token_files
from evigraph.llm.shared import Scratch

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(spans, "SLICE_BYTES", 64)


def _lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def _grams(t):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    return [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


ODD = [None, "", " \t\n", "Hello, World é Ünïcode-x 12", "a", "a b", "x" * 300 + " y " + "z" * 70 + " w", "word " * 3000]


def test_composed_crcs_equal_those_of_the_strings(small):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcÄé .,\n9Z中") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    got = {}
    for _, _, grams in resampling.features(pa.array(texts)):
        for rows, crcs in grams:
            for r, c in zip(rows.tolist(), crcs.tolist()):
                got.setdefault(r, []).append(c)
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(map(zlib.crc32, _grams(t)))


def test_crc_of_any_length():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1000, 70_001):
        a, b = rng.bytes(9), rng.bytes(n)
        got = resampling.combine(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert got[0] == zlib.crc32(a + b)


def _resample(docs, target, percent, least):
    s, t = Counter(), Counter()
    for c, rows in ((s, [x for _, x in docs]), (t, target)):
        for x in rows:
            c.update(zlib.crc32(g) % 10_000 for g in _grams(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000))))
    out = []
    for k, x in docs:
        g = _grams(x)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(f) % 10_000) for f in g)
        words = len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(x)))
        out.append((k, words, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    return out, [r[0] for r in able[: percent * len(able) // 100]]


def test_resampling_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "USUAL_ROWS", 7)
    rng = random.Random(2)
    docs = list(enumerate(ODD)) + [(None, "the quick fox " * 9), (3, "a b c d e"), (3, "a b c d e")] + [(100 + i, " ".join(rng.choice(["the", "fox", "x", "y", "é"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    target = ["the quick brown fox", None, ""]
    rows = spark.createDataFrame([(k, x, "r", 1) for k, x in docs], "doc_id long, text string, rank string, bucket int").repartition(5)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(rows, "doc_id", "text", goal, "text", percent=30, least_words=5).collect()
    want, drawn = _resample(docs, target, 30, 5)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [r["doc_id"] for r in ranked] == drawn
    assert resampling.resample(rows.limit(0), "doc_id", "text", goal, "text").collect() == []
    assert len(resampling.resample(rows, "doc_id", "text", goal.limit(0), "text").collect()) == len(docs)


def _collocations(rows, least, longest, top, covered):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", _lower(text)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    able = [(lang, g) for (lang, g), a in f.items() if len(g) > 1 and a >= least]
    inside = {(lang, g[i : i + k], f[lang, g]) for lang, g in able for k in range(2, len(g)) for i in range(len(g) - k + 1)}
    most = {}
    for lang, g, a in inside:
        most[lang, g] = max(most.get((lang, g), 0), a)
    out = {}
    for lang, g in able:
        a = f[lang, g]
        if 100 * most.get((lang, g), 0) >= covered * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, b" ".join(g), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s, p.count(b" ") + 1) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_of_odd_rows(spark, small, monkeypatch, longest):
    monkeypatch.setattr(collocations, "GATHER", 150)
    monkeypatch.setattr(collocations, "RANGE", 40)
    rng = random.Random(longest)
    words = ["the", "The", "of", "a", "é", "中文", "x.y", "rare", "b\x00c", "New York", "new york city"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " "]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), (None, None), ("en", ""), ("hot", "hot pair " * 400), ("hot", "hot pair " * 400)]
    docs = spark.createDataFrame([(a, b, "p", 5) for a, b in rows], "lang string, text string, phrase string, n int").repartition(6)
    got = collocations.find_collocations(docs, "text", "lang", least=4, longest=longest, top=25, covered=50).collect()
    assert sorted(tuple(r) for r in got) == _collocations(rows, 4, longest, 25, 50)
    assert collocations.find_collocations(docs.limit(0), "text", "lang").collect() == []
    with pytest.raises(ValueError):
        collocations.find_collocations(docs, "text", "lang", longest=1)


def test_parts_counted_in_another_range(spark, monkeypatch):
    """One pair with very many followers is spread over ranges; its own count is then fetched, not walked to."""
    monkeypatch.setattr(collocations, "RANGE", 30)
    rng = random.Random(5)
    rows = [("en", " ".join(f"hot pair w{rng.randint(0, 30)} ." for _ in range(40))) for _ in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    words, _ = collocations.count_words(docs, Scratch(spark, "t"), 3)
    scratch = Scratch(spark, "t")
    collocations.count_phrases(docs, words, scratch, 3, 3)
    nodes = spark.read.parquet(scratch.path("nodes"))
    assert nodes.filter("exists(lefts, x -> x is null)").count() > 0
    got = collocations.find_collocations(docs, "text", "lang", least=3).collect()
    assert sorted(tuple(r) for r in got) == _collocations(rows, 3, 3, 2000, 50)


def test_large_counts_are_exact(spark):
    big = 9_000_000_000_007
    row = spark.range(1).select(collocations.weakest_cut(F.lit(big), F.array(F.lit(big + 1), F.lit(big + 5)), F.array(F.lit(big + 3), F.lit(big))).alias("c")).first()["c"]
    assert tuple(row) == min((1_000_000 * big * big // (a * b), k, a, b) for k, (a, b) in enumerate([(big + 1, big + 3), (big + 5, big)], 1))


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000, rans.BLOCK_IDS, 2 * rans.BLOCK_IDS + 777])
def test_numerals_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 50_256).astype(np.uint32)
    counts = np.bincount(ids)
    of = rans.table(rans.normalise(counts))
    assert of.freq.sum() == 1 << rans.BITS and ((of.freq > 0) == (counts > 0)).all()
    blocks = rans.encode(ids, of)
    assert (rans.decode(blocks, of) == ids).all() and (rans.decode(blocks[1:], of) == ids[rans.BLOCK_IDS :]).all()
    if n > 1000:
        p = counts[counts > 0] / n
        assert 24 * sum(len(b.words) for b in blocks) < 1.02 * n * -(p * np.log2(p)).sum() + 48 * rans.LANES * len(blocks)
        blocks[0].words[len(blocks[0].words) // 2] ^= 1
        with pytest.raises(ValueError):
            rans.decode(blocks, of)


def test_more_ids_than_shares():
    counts = np.ones(900_000, np.int64)
    counts[7] = 10**9
    freq = rans.normalise(counts)
    assert freq.sum() == 1 << rans.BITS and freq.min() == 1


def test_cut_texts_encode_as_the_library_does(small):
    encoder = token_files.Encoder(open(JSON).read())
    rng = random.Random(3)
    alpha = [*"abXY01.,;!?'\"&#$%-_ \n\téÉ×÷ñß 　中€́\x00\x1c\r\x85", "'s", "'ll", "'re", " ' ", "  ", "\n\n", " \n"]
    texts = [None, ""] + ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    texts += ["".join(rng.choice("ab 'sé.\n1") for _ in range(rng.randint(0, 30))) for _ in range(5000)] + ["to <|endoftext|> be", "<|endoftext|>"]
    want = [e.ids for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = []
    for _, ids, lens in encoder.rows(pa.array(texts)):
        ends = np.cumsum(lens)
        got += [ids[z - n : z].tolist() for z, n in zip(ends, lens)]
    assert got == want


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 3)
    encoder = token_files.Encoder(open(JSON).read())
    for texts in (["a b c d e"], ["f g a b"], ["a a a", "zz"]):
        got = [ids.tolist() for _, ids, _ in encoder.rows(pa.array(texts))]
        assert sum(got, []) == sum((encoder.library.encode(t, add_special_tokens=False).ids for t in texts), [])


def _store(rows, library):
    start, out = 0, []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_token_files_of_odd_rows(spark, monkeypatch):
    """Files so small that documents lie across files, groups and segments."""
    monkeypatch.setattr(token_files, "FILE_IDS", 2 * rans.BLOCK_IDS + 1000)
    monkeypatch.setattr(token_files, "GROUP_BLOCKS", 1)
    monkeypatch.setattr(token_files, "USUAL_ROWS", 3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, " x" * (3 * rans.BLOCK_IDS + 5)), (60, "end")]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows] + [(None, "no key", "s")], "doc_id long, text string, start string").repartition(3)
    got = sorted((tuple(r) for r in token_files.store_tokens(docs, "doc_id", "text", JSON, 2, with_ids=True).collect()), key=lambda r: r[1])
    want = _store([(None, "no key"), *rows], token_files.Encoder(open(JSON).read()).library)
    assert got == want
    assert token_files.store_tokens(docs.limit(0), "doc_id", "text", JSON, 2).collect() == []
    twice = token_files.store_tokens(docs.filter("doc_id = 3").unionByName(docs.filter("doc_id = 3")), "doc_id", "text", JSON, 2).collect()
    assert len({r["start"] for r in twice}) == 2 and len({r["ids_crc32"] for r in twice}) == 1


def test_damage_is_told(tmp_path):
    ids = np.arange(5000, dtype=np.uint32) % 77
    uri = token_files.write_file(f"file://{tmp_path}", ids, [token_files.Piece(0, 5000, 0, "k")])
    with token_files.TokenFile(uri) as f:
        assert (f.ids(0, 9) == ids).all() and f.pieces() == [token_files.Piece(0, 5000, 0, "k")]
    path = uri.removeprefix("file://")
    raw = open(path, "rb").read()
    for at in range(8, len(raw), 97):
        with open(path, "wb") as f:
            f.write(raw[:at] + bytes([raw[at] ^ 4]) + raw[at + 1 :])
        with pytest.raises(ValueError), token_files.TokenFile(uri) as f:
            f.ids(0, 9), f.pieces()
    with open(path, "wb") as f:
        f.write(raw[:-9])
    with pytest.raises(ValueError):
        token_files.TokenFile(uri)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_token_query_equals_the_library(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    want = [r[:4] for r in _store(rows, token_files.Encoder(open(JSON).read()).library)]
    assert sorted((tuple(r) for r in queries.op13_rans_token_files(spark, SF).collect()), key=lambda r: r[1]) == want
