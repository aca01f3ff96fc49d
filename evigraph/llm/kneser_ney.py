"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Counting deals packed, pre-aggregated arrays instead of rows. Words are 64-bit hashes; the sorted
array of all of them is the vocabulary, and a word's number is its place in it, so a bigram is one
64-bit integer. Vocabulary, bigrams, contexts and continuations are sorted arrays in files of the
shared folder. Each task writes files of its own names and reports them; only reported files are
used. Nothing is pruned: all bigrams of the training texts are in the model.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import bytescan
from evigraph.llm.shared import Scratch

#: The hash that stands for the end of a text.
END = np.uint64(0x5E2D58D8B3BCDEE1)
#: Tokens or pairs that a task gathers before it packs them.
GATHER = 3_000_000
#: Pairs, as gathered, of one bucket.
BUCKET = 3_000_000
#: Words with at least this share of all tokens have their pairs dealt over all buckets; at most so many exist.
HOT_WORDS = 1000
_FIRST = 1 << 32  # context number of the beginning of a text; word numbers are below it


def pack(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, which compress well when values are sorted or small."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).reshape(-1).view(kind)


def merge(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    if counts is None:
        return np.unique(k, return_counts=True)
    names, back = np.unique(k, return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, back, np.concatenate(counts) if counts else np.empty(0, np.int64))
    return names, total


def token_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of words with an end after each text, bounds of texts)."""
    for lo, hi, hashes, bounds in bytescan.texts(column):
        yield lo, hi, np.insert(hashes, bounds[1:], END), bounds + np.arange(len(bounds))


def _write(root: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays beside each other under a new name; returns the name's URI."""
    system, path = arrow_fs.FileSystem.from_uri(root)
    system.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    for k, v in arrays.items():
        with system.open_output_stream(f"{path}/{name}.{k}", compression=None) as f:
            f.write(np.ascontiguousarray(v).tobytes())
    return f"{root}/{name}"


_mapped: dict[str, np.ndarray] = {}


def mapped(uri: str, kind: type, rows: int) -> np.ndarray:
    """A file as a read-only array in memory-mapped pages.

    Where the shared folder is no file system of this machine, the file is first copied to an
    unlinked temporary file, which is gone with the worker.
    """
    held = _mapped.get(uri)
    if held is None:
        if rows == 0:
            held = np.empty(0, kind)
        elif uri.startswith("file:") or uri.startswith("/"):
            held = np.memmap(arrow_fs.FileSystem.from_uri(uri)[1], kind, "r", shape=(rows,))
        else:
            system, path = arrow_fs.FileSystem.from_uri(uri)
            handle, name = tempfile.mkstemp()
            with os.fdopen(handle, "wb") as out, system.open_input_stream(path, compression=None) as f:
                while data := f.read(1 << 20):
                    out.write(data)
            held = np.memmap(name, kind, "r", shape=(rows,))
            os.unlink(name)
        if len(_mapped) > 4000:
            _mapped.clear()
        _mapped[uri] = held
    return held


@dataclass
class Vocabulary:
    """Words in files by the leading bits of their hashes."""

    bits: int
    uris: list[str]
    rows: list[int]
    base: list[int]
    tokens: int
    hot: list[int] = field(default_factory=list)

    @property
    def size(self) -> int:
        return self.base[-1] + self.rows[-1] if self.rows else 0

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.zeros(1, np.int64)
        cut = np.append(cut, len(hashes))
        for b, (uri, rows) in enumerate(zip(self.uris, self.rows)):
            part = slice(cut[b], cut[b + 1])
            if cut[b + 1] > cut[b] and rows:
                words, counts = mapped(f"{uri}.h", np.uint64, rows), mapped(f"{uri}.n", np.int64, rows)
                at = np.searchsorted(words, hashes[part])
                at[at == rows] = 0
                ok = words[at] == hashes[part]
                number[part] = np.where(ok, at + self.base[b], -1)
                count[part] = np.where(ok, counts[at], 0)
        return number, count


def _count_words(bits: int):
    """(text) to packed (bucket, hashes, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def part() -> pa.RecordBatch:
            names, counts = merge([k for k, _ in held], [c for _, c in held])
            cut = np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
            cut = np.append(cut, len(names))
            full = [b for b in range(1 << bits) if cut[b + 1] > cut[b]]
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([pack(names[cut[b] : cut[b + 1]]) for b in full], pa.binary()), pa.array([pack(counts[cut[b] : cut[b + 1]]) for b in full], pa.binary())],
                names=["b", "k", "n"],
            )

        for batch in batches:
            for _, _, hashes, _ in token_hashes(batch.column(0)):
                names, counts = np.unique(hashes, return_counts=True)
                held.append((names, counts.astype(np.int64)))
                size += len(names)
                if size > GATHER:
                    yield part()
                    held, size = [], 0
        if held:
            yield part()

    return run


def _store_words(root: str):
    def run(table: pa.Table) -> pa.Table:
        names, counts = merge([unpack(k, np.uint64) for k in table.column("k").to_pylist()], [unpack(n, np.int64) for n in table.column("n").to_pylist()])
        top = np.argsort(counts)[-HOT_WORDS:]
        return pa.table(
            {
                "b": pa.array([table.column("b")[0].as_py()], pa.int32()),
                "uri": [_write(root, {"h": names, "n": counts})],
                "rows": pa.array([len(names)], pa.int64()),
                "tokens": pa.array([int(counts.sum())], pa.int64()),
                "top": pa.array([[[int(i), int(counts[i])] for i in top]], pa.list_(pa.list_(pa.int64()))),
            }
        )

    return run


def fit_vocabulary(texts: DataFrame, scratch: Scratch) -> Vocabulary:
    """Count every word of the one column of texts (null reads as empty); one bucket for each partition or so."""
    bits = max(3, (max(1, texts.rdd.getNumPartitions()) - 1).bit_length())
    counted = texts.mapInArrow(_count_words(bits), "b int, k binary, n binary")
    stored = scratch.save(counted.groupBy("b").applyInArrow(_store_words(scratch.path("words")), "b int, uri string, rows long, tokens long, top array<array<bigint>>"), "word-files")
    found = {r["b"]: r for r in stored.select("b", "uri", "rows", "tokens").collect()}
    uris = [found[b]["uri"] if b in found else "" for b in range(1 << bits)]
    rows = [found[b]["rows"] if b in found else 0 for b in range(1 << bits)]
    base = [0, *np.cumsum(rows).tolist()][:-1]
    tokens = sum(r["tokens"] for r in found.values())
    # a word of at least 1 / HOT_WORDS of all tokens: there can't be more than HOT_WORDS of them
    top = stored.select("b", F.explode("top").alias("w")).filter(F.col("w")[1] * HOT_WORDS >= tokens).collect()
    return Vocabulary(bits, uris, rows, base, tokens, sorted(base[r["b"]] + r["w"][0] for r in top))


def _pairs(vocabulary: Vocabulary, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, count of word) of every token; -1 where unknown, _FIRST before a text."""
    names, back = np.unique(hashes, return_inverse=True)
    number, count = vocabulary.numbers(names)
    word = number[back]
    context = np.empty(len(word), np.int64)
    context[1:] = word[:-1]
    context[bounds[:-1]] = _FIRST
    return context, word, count[back]


def _bucket_of(context: np.ndarray, word: np.ndarray, size: int, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair: by range of its context; pairs of hot contexts by hash."""
    at = np.minimum(context * buckets // max(1, size), buckets - 1)
    spread = (bytescan.mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    i = np.searchsorted(hot, context)
    i[i == len(hot)] = 0
    heavy = (context == _FIRST) | ((hot[i] == context) if len(hot) else False)
    return np.where(heavy, spread, at)


def _key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.where(context == _FIRST, 0xFFFFFFFF, context).astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


def _count_pairs(vocabulary: Vocabulary, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, hot = [], 0, np.array(vocabulary.hot, np.int64)

        def part() -> pa.RecordBatch:
            keys, counts = merge(held)
            context = (keys >> np.uint64(32)).astype(np.int64)
            context[context == 0xFFFFFFFF] = _FIRST
            at = _bucket_of(context, (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), vocabulary.size, hot, buckets)
            order = np.argsort(at, kind="stable")
            cut = np.searchsorted(at[order], np.arange(buckets + 1))
            full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
            parts = [order[cut[b] : cut[b + 1]] for b in full]
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([pack(keys[p]) for p in parts], pa.binary()), pa.array([pack(counts[p].astype(np.uint32)) for p in parts], pa.binary())], names=["b", "k", "n"]
            )

        for batch in batches:
            for _, _, hashes, bounds in token_hashes(batch.column(0)):
                context, word, _ = _pairs(vocabulary, hashes, bounds)
                held.append(_key(context, word))
                size += len(word)
                if size > GATHER:
                    yield part()
                    held, size = [], 0
        if held:
            yield part()

    return run


def _grades(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _store_pairs(root: str, size: int, hot: list[int], buckets: int):
    """One bucket: its sorted pairs, its contexts' totals, and its words' continuation counts packed for their own buckets."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = merge([unpack(k, np.uint64) for k in table.column("k").to_pylist()], [unpack(n, np.uint32).astype(np.int64) for n in table.column("n").to_pylist()])
        context, first = np.unique((keys >> np.uint64(32)).astype(np.int64), return_index=True)
        stats = np.stack([np.add.reduceat(x, first) for x in (counts, counts == 1, counts == 2, counts > 2)], axis=1).astype(np.int64)
        heavy = np.isin(context, np.array([*hot, 0xFFFFFFFF]))
        light = ~heavy
        uri = _write(root, {"k": keys, "n": np.minimum(counts, 0xFFFFFFFF).astype(np.uint32), "c": context[light].astype(np.uint32), "s": stats[light]})
        word, after = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
        cut = np.searchsorted(np.minimum(word.astype(np.int64) * buckets // max(1, size), buckets - 1), np.arange(buckets + 1))
        full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        b = table.column("b")[0].as_py()
        none = [None] * len(full)
        return pa.table(
            {
                "b": pa.array([b, *full], pa.int32()),
                "uri": pa.array([uri, *none], pa.string()),
                "rows": pa.array([len(keys), *none], pa.int64()),
                "contexts": pa.array([int(light.sum()), *none], pa.int64()),
                "grades": pa.array([_grades(counts), *none], pa.list_(pa.int64())),
                "heavy": pa.array([[[int(c), *map(int, s)] for c, s in zip(context[heavy], stats[heavy])], *none], pa.list_(pa.list_(pa.int64()))),
                "k": pa.array([None, *(pack(word[cut[i] : cut[i + 1]]) for i in full)], pa.binary()),
                "n": pa.array([None, *(pack(after[cut[i] : cut[i + 1]].astype(np.uint32)) for i in full)], pa.binary()),
            }
        )

    return run


def _store_continuations(root: str):
    def run(table: pa.Table) -> pa.Table:
        words, counts = merge([unpack(k, np.uint32).astype(np.uint64) for k in table.column("k").to_pylist()], [unpack(n, np.uint32).astype(np.int64) for n in table.column("n").to_pylist()])
        uri = _write(root, {"w": words.astype(np.uint32), "n": counts})
        more = int((counts > 2).sum())
        return pa.table({"b": pa.array([table.column("b")[0].as_py()], pa.int32()), "uri": [uri], "rows": pa.array([len(words)], pa.int64()), "grades": pa.array([_grades(counts)], pa.list_(pa.int64())), "more": pa.array([more], pa.int64())})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many counts are 1 to 4; each is kept within (0, its count)."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(float(min(max(d, 0.05), k - 0.05)) for k, d in zip((1, 2, 3), raw))


@dataclass
class Model:
    vocabulary: Vocabulary
    buckets: int
    pairs: list[tuple[str, int, int]]  # uri, pairs, contexts by bucket
    heavy: dict[int, tuple[int, int, int, int]]
    words: list[tuple[str, int]]  # uri, rows of continuations by bucket
    high: tuple[float, float, float]
    low: tuple[float, float, float]
    kinds: int  # distinct pairs
    spare: float  # share of the lowest order that goes to the uniform distribution

    def _discount(self, c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.where(c > 2, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))

    def _lookup(self, bucket: np.ndarray, keys: np.ndarray, name: str, kind: type, value: tuple, which) -> np.ndarray:
        """Rows of values for keys, bucket by bucket; keys are sorted within a bucket."""
        suffix, value_kind, wide = value
        out = np.zeros((len(keys), wide), np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            uri, rows = which(b)
            if rows:
                p = order[cut[b] : cut[b + 1]]
                held = mapped(f"{uri}.{name}", kind, rows)
                values = mapped(f"{uri}.{suffix}", value_kind, rows * wide).reshape(rows, wide)
                at = np.searchsorted(held, keys[p].astype(kind))
                at[at == rows] = 0
                ok = held[at] == keys[p].astype(kind)
                out[p] = np.where(ok[:, None], values[at], 0)
        return out

    def lowest(self, words: np.ndarray) -> np.ndarray:
        """Continuation probabilities of sorted distinct word numbers (-1: unknown)."""
        size = self.vocabulary.size
        known = np.maximum(words, 0)
        c = self._lookup(np.minimum(known * self.buckets // max(1, size), self.buckets - 1), known, "w", np.uint32, ("n", np.int64, 1), lambda b: self.words[b])[:, 0]
        c[words < 0] = 0
        return np.maximum(c - self._discount(c, self.low), 0) / max(1, self.kinds) + self.spare / (size + 1)

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of every word after its context."""
        names, back = np.unique(word, return_inverse=True)
        low = self.lowest(names)[back]
        hot, size = np.array(self.vocabulary.hot, np.int64), self.vocabulary.size
        # contexts
        seen, where = np.unique(context, return_inverse=True)
        stats = np.zeros((len(seen), 4), np.int64)
        usual = np.flatnonzero((seen >= 0) & (seen != _FIRST))
        if len(usual):
            at = np.minimum(seen[usual] * self.buckets // max(1, size), self.buckets - 1)
            stats[usual] = self._lookup(at, seen[usual], "c", np.uint32, ("s", np.int64, 4), lambda b: (self.pairs[b][0], self.pairs[b][2]))
        for i, c in enumerate(seen):
            if (s := self.heavy.get(int(c))) is not None:
                stats[i] = s
        stats = stats[where]
        # pairs
        count = np.zeros(len(word), np.int64)
        both = np.flatnonzero((context >= 0) & (word >= 0))
        if len(both):
            keys, first, again = np.unique(_key(context[both], word[both]), return_index=True, return_inverse=True)
            at = _bucket_of(context[both][first], word[both][first], size, hot, self.buckets)
            count[both] = self._lookup(at, keys, "k", np.uint64, ("n", np.uint32, 1), lambda b: self.pairs[b][:2])[:, 0][again]
        total = stats[:, 0]
        free = (self.high[0] * stats[:, 1] + self.high[1] * stats[:, 2] + self.high[2] * stats[:, 3]) / np.maximum(total, 1)
        p = np.where(total > 0, np.maximum(count - self._discount(count, self.high), 0) / np.maximum(total, 1) + free * low, low)
        return np.log10(p)


def fit(docs: DataFrame, text: str) -> Model:
    """Count a model over every whole text of docs (null reads as empty)."""
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    texts = docs.select(F.col(text).alias("text"))
    vocabulary = fit_vocabulary(texts, scratch)
    buckets = max(4, -(-vocabulary.tokens // BUCKET))
    counted = texts.mapInArrow(_count_pairs(vocabulary, buckets), "b int, k binary, n binary")
    schema = "b int, uri string, rows long, contexts long, grades array<bigint>, heavy array<array<bigint>>, k binary, n binary"
    stored = scratch.save(counted.groupBy("b").applyInArrow(_store_pairs(scratch.path("pairs"), vocabulary.size, vocabulary.hot, buckets), schema), "pair-files")
    pairs, heavy, grades, kinds = [("", 0, 0)] * buckets, {}, np.zeros(4, np.int64), 0
    for r in stored.filter("uri is not null").select("b", "uri", "rows", "contexts", "grades", "heavy").collect():
        pairs[r["b"]] = (r["uri"], r["rows"], r["contexts"])
        grades += r["grades"]
        kinds += r["rows"]
        for c, *s in r["heavy"]:
            key = _FIRST if c == 0xFFFFFFFF else c
            heavy[key] = tuple(np.add(heavy.get(key, (0, 0, 0, 0)), s).tolist())
    joined = stored.filter("k is not null").select("b", "k", "n").groupBy("b").applyInArrow(_store_continuations(scratch.path("continuations")), "b int, uri string, rows long, grades array<bigint>, more long")
    words, low_grades, more = [("", 0)] * buckets, np.zeros(4, np.int64), 0
    for r in scratch.save(joined, "word-counts").collect():
        words[r["b"]] = (r["uri"], r["rows"])
        low_grades += r["grades"]
        more += r["more"]
    scratch.drop("pair-files")
    high, low = discounts(*map(int, grades)), discounts(*map(int, low_grades))
    spare = (low[0] * low_grades[0] + low[1] * low_grades[1] + low[2] * more) / kinds if kinds else 1.0
    return Model(vocabulary, buckets, pairs, heavy, words, high, low, kinds, float(spare))


def score(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """Score every whole text; one row per row of docs.

    Columns: key, n_tokens (words and one end), n_known (tokens that the training texts have),
    train_tokens, base_score (add-one-half unigrams), score (log10 probability under the model),
    perplexity. A null text is an empty one: its end alone. Null keys and repeated rows keep a row
    each; an empty table gives no rows; without any training text all words are unknown and
    equally likely. Only the two named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = model.vocabulary.size, model.vocabulary.tokens
        for batch in batches:
            n, known, base, full = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, np.float64, np.float64))
            for lo, hi, hashes, bounds in token_hashes(batch.column(1)):
                context, word, count = _pairs(model.vocabulary, hashes, bounds)
                n[lo:hi] = np.diff(bounds)
                known[lo:hi] = np.add.reduceat((count > 0).astype(np.int64), bounds[:-1])
                base[lo:hi] = np.add.reduceat(np.log10((count + 0.5) / (total + 0.5 * (size + 1))), bounds[:-1])
                full[lo:hi] = np.add.reduceat(model.log10(context, word), bounds[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (n, known, np.full(len(n), total), base, full, 10 ** np.minimum(-full / np.maximum(n, 1), 300)))],
                names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").withColumnRenamed("key", key)
