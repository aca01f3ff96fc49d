"""Toxicity scores after noisy-channel deobfuscation.

A word that looks disguised is a lattice: a sign may stand for a letter (leetspeak), a repeated
letter for one or two, and marks or spaces between single letters for nothing. Viterbi decoding
finds the restoration that a character language model and the costs of the disguises make most
likely. Words without such signs have one path and restore to themselves. The restored words, and
their beginnings, are then scored by evidence learnt from labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import bytescan
from evigraph.llm.kneser_ney import _write, mapped
from evigraph.llm.shared import Scratch, likely, trim
from evigraph.llm.wordtable import WordTable, add_rows

# What signs may stand for, marks that may part letters, and costs in natural logarithms.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
MARKS = " .-_*~,:/\\'`^#"
COST_LEET, COST_SIGN, COST_MARK, COST_REPEAT, COST_KEEP_RUN, COST_PART, COST_LOSE = 1.0, 5.0, 0.7, 1.5, 6.0, 3.0, 4.0
#: Classes of bytes in the language model: white space, a-z, digit, other ASCII, first byte, following byte.
CLASSES = 94
#: A feature must be in so many toxic texts, and so much (in logarithms) likelier in them.
LEAST_TEXTS, LEAST_EVIDENCE = 3, 2.5
#: Features of one file of evidence, and files at least; their number grows with the features.
FILE_FEATURES, LEAST_FILES = 200_000, 16
PREFIXES = (4, 5, 6, 8)
#: Labelled texts on which the two weights of the score are fitted.
FIT_TEXTS = 20_000
#: Words whose features a worker keeps, and features that it counts before it sends them; runs whose evidence it keeps.
KEPT_FEATURES, KEPT_RUNS = 80_000, 20_000

_CLASS = np.full(256, 28, np.int64)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = 27
_CLASS[0xC0:] = 29
_CLASS[0x80:0xC0] = np.arange(30, 94)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of byte classes in texts, each text within white space."""
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        data, offsets = bytescan.buffers(batch.column(0))
        for lo, hi in bytescan.runs(offsets):
            cuts = offsets[lo : hi + 1]
            if hi - lo == 1:
                spans = [(a, min(a + (1 << 20) + 2, cuts[1])) for a in range(cuts[0], cuts[1], 1 << 20)]
                parts = [data[a:b] for a, b in spans]
            else:
                parts = [data[cuts[0] : cuts[-1]]]
            for part in parts:
                c = np.r_[0, 0, _CLASS[part], 0]
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])


class CharModel:
    """Interpolated trigram model over byte classes."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 0.5) / (uni + 0.5).sum()
        p2 = (bi + 2 * p1) / (bi.sum(axis=1, keepdims=True) + 2)
        p3 = (tri + 4 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 4)
        self.table = np.log(p3).astype(np.float32)

    @staticmethod
    def fit(docs: DataFrame, text: str) -> CharModel:
        """Counted over all texts; the table has CLASSES ** 3 entries whatever the corpus."""
        rows = docs.select(F.col(text).alias("text")).filter("text is not null")
        counts = np.zeros(CLASSES**3, np.int64)
        for r in rows.mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
            counts[r["code"]] = r["n"]
        return CharModel(counts)


def _options(text: str, i: int) -> list[tuple[int, str, float]]:
    """Edges of the lattice at position i: (next position, emitted text, cost)."""
    c, end = text[i], i + 1
    if c.isalpha():
        while end < len(text) and text[end] == c:
            end += 1
        run = end - i
        if run == 1:
            return [(end, c, 0.0)]
        if run == 2:
            return [(end, c + c, 0.0), (end, c, COST_REPEAT + 2)]
        return [(end, c * run, COST_KEEP_RUN), (end, c, COST_REPEAT), (end, c + c, COST_REPEAT)]
    out = [(end, letter, COST_LEET) for letter in LEET.get(c, "")]
    if c in MARKS or not c.isalnum():
        out.append((end, "", COST_LOSE if c in LEET else COST_MARK))
        out.append((end, " ", COST_PART))
    if not c.isspace():
        out.append((end, c, COST_SIGN))
    return out


def decode(text: str, model: CharModel) -> str:
    """The likeliest restoration of a disguised word (or of letters parted by spaces), by Viterbi decoding."""
    table, done = model.table, []
    at: dict[int, dict[tuple[int, int], tuple[float, tuple]]] = {0: {(0, 0): (0.0, ())}}
    for i in range(len(text)):
        states = at.pop(i, None)
        if not states:
            continue
        if len(states) == 1 and not at:  # all paths meet: what is behind is settled
            (key, (score, path)), = states.items()
            done.extend(_emitted(path))
            states = {key: (score, ())}
        edges = [(to, s, cost, [int(k) for k in _CLASS[np.frombuffer(s.encode(), np.uint8)]]) for to, s, cost in _options(text, i)]
        for (a, b), (score, path) in states.items():
            for to, s, cost, codes in edges:
                x, y, total = a, b, score - cost
                for k in codes:
                    total += float(table[x, y, k])
                    x, y = y, k
                into = at.setdefault(to, {})
                known = into.get((x, y))
                if known is None or total > known[0]:
                    into[x, y] = (total, (path, s))
    best, path = max(((score + float(table[a, b, 0]), path) for (a, b), (score, path) in at[len(text)].items()), key=lambda z: z[0])
    return "".join([*done, *_emitted(path)])


def _emitted(path: tuple) -> list[str]:
    out = []
    while path:
        path, s = path
        out.append(s)
    return out[::-1]


_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$|")


def disguised(core: str) -> bool:
    """Whether a word, bare of outer punctuation, has more than one path: letters with signs among them, or a letter three times running."""
    if core.isalpha():
        return any(a == b == c for a, b, c in zip(core, core[1:], core[2:]))
    return any(map(str.isalpha, core))


def restore_word(word: str, model: CharModel) -> list[str]:
    """The restored words of one word; what is no disguise stays, without outer punctuation."""
    word = word.lower()
    core = word.strip(_EDGE)
    if not disguised(core):
        return [core] if core else []
    return [w for part in decode(core, model).split() if (w := part.strip(_EDGE))]


def joins(word: str) -> bool:
    """Whether a word may be one of the parts of a word parted by spaces: a single letter, leetspeak sign or mark."""
    return len(word) == 1 and (word.isalpha() or word in LEET or word in MARKS)


def spaced(run: list[str]) -> bool:
    """Whether joining words in a row are decoded as one: three or more with some letter."""
    return len(run) > 2 and any(map(str.isalpha, run))


def restore_text(text: str, model: CharModel) -> str:
    """A text with its disguised words and its letters parted by spaces restored; white space becomes single spaces."""
    out, letters = [], []
    for word in [*text.split(), ""]:
        if joins(word):
            letters.append(word)
            continue
        if letters:
            out.extend(decode(" ".join(letters).lower(), model).split() if spaced(letters) else letters)
            letters = []
        if word:
            core = word.lower().strip(_EDGE)
            out.extend(restore_word(word, model) if disguised(core) else [word])
    return " ".join(out)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


def _hashes(found: list[str]) -> np.ndarray:
    """64-bit hashes of features, which hold no white space."""
    return bytescan.words(np.frombuffer(" ".join(found).encode(), np.uint8)).hashes


@dataclass
class Evidence:
    """The evidence of every feature that passed, by its hash: sorted arrays in files of the shared folder, by ranges of hashes."""

    uris: list[str]
    rows: list[int]

    def of(self, found: list[str]) -> np.ndarray:
        """The evidence of features; 0 for those that have none."""
        out = np.zeros(len(found))
        if not self.uris or not found:
            return out
        names, back = np.unique(_hashes(found), return_inverse=True)
        values = np.zeros(len(names))
        cut = np.searchsorted(_file(names, len(self.uris)), np.arange(len(self.uris) + 1))
        for b, (uri, rows) in enumerate(zip(self.uris, self.rows)):
            if rows and cut[b + 1] > cut[b]:
                part = slice(cut[b], cut[b + 1])
                held = mapped(f"{uri}.h", np.uint64, rows)
                at = np.searchsorted(held, names[part])
                at[at == rows] = 0
                values[part] = np.where(held[at] == names[part], mapped(f"{uri}.w", np.float64, rows)[at], 0)
        return values[back]


def _file(hashes: np.ndarray, files: int) -> np.ndarray:
    """The file of each hash; ascending with the hashes."""
    return ((hashes >> np.uint64(40)) * np.uint64(files) >> np.uint64(24)).astype(np.int64)


def _store_evidence(root: str):
    def run(table: pa.Table) -> pa.Table:
        names = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(names)
        uri = _write(root, {"h": names[order], "w": table.column("w").to_numpy()[order]})
        return pa.table({"b": pa.array([table.column("b")[0].as_py()], pa.int32()), "uri": [uri], "rows": pa.array([len(names)], pa.int64())})

    return run


@dataclass
class ToxicityModel:
    chars: CharModel
    evidence: Evidence
    weights: tuple[float, float, float]

    def word_values(self, words: list[bytes]) -> np.ndarray:
        """For each word: the evidence of its best restored word or beginning, and 1 to count it."""
        out = np.ones((len(words), 2), np.float32)
        for lo in range(0, len(words), 50_000):
            out[lo : lo + 50_000, 0] = self.best([restore_word(raw.decode("utf-8", "replace"), self.chars) for raw in words[lo : lo + 50_000]])
        return out

    def best(self, restored: list[list[str]]) -> np.ndarray:
        """For each list of restored words: the evidence of the best of them or of their beginnings."""
        made = [[f for w in words for f in features(w)] for words in restored]
        sizes = np.array([len(m) for m in made], np.int64)
        out, full = np.zeros(len(made)), np.flatnonzero(sizes)
        if len(full):
            out[full] = np.maximum.reduceat(self.evidence.of([f for m in made for f in m]), (np.cumsum(sizes) - sizes)[full])
        return out

    def inputs(self, sums: np.ndarray) -> np.ndarray:
        """From (evidence, words) of texts: what the weights apply to."""
        evidence, words = sums[:, 0], np.maximum(sums[:, 1], 1)
        return np.stack([np.ones(len(sums)), np.log1p(evidence), np.log1p(100 * evidence / words)], axis=1)

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(sums) @ np.array(self.weights), -30, 30)))


_ONE_BYTE = np.array([joins(chr(c)) for c in range(128)] + [False] * 128)
#: Runs of up to so many words whose evidence a worker keeps.
KEPT_RUN = 128


class _Runs:
    """Runs of joining words, three or more in a row of one text; a run that meets the end of a slice goes on in the next."""

    def __init__(self):
        self.row, self.open = -1, []

    def of(self, lo: int, rows: np.ndarray, found: bytescan.Words) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(row, run) of the runs that end in this slice."""
        size, first = found.ends - found.starts, found.data[found.starts]
        single = np.where(size == 1, _ONE_BYTE[first], (size == 2) & (first >= 0xC0) & (first < 0xE0) | (size == 3) & (first >= 0xE0) & (first < 0xF0) | (size == 4) & (first >= 0xF0))
        edge = np.flatnonzero(np.diff(np.r_[False, single, False]))
        last = len(rows) - 1
        if self.open and (not single[0] or rows[0] + lo != self.row):
            yield from self.rest()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < 3 and a > 0 and b <= last:
                continue
            for k in range(a, b):
                word, row = found.data[found.starts[k] : found.ends[k]].tobytes().decode("utf-8", "replace"), int(rows[k]) + lo
                if row != self.row or not joins(word):
                    yield from self.rest()
                if joins(word):
                    self.row = row
                    self.open.append(word.lower())
            if b <= last:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[int, tuple[str, ...]]]:
        """The run that is still open."""
        run, self.open = self.open, []
        if spaced(run):
            yield self.row, tuple(run)


def _text_sums(model: ToxicityModel):
    """(key, text, more) batches to the batch and its texts' sums of word values; each word restored from a spaced run counts."""
    table, memo = WordTable(model.word_values, 2), {}

    def value_of(run: tuple[str, ...]) -> float:
        value = memo.get(run)
        if value is None:
            value = float(model.best([[w] for w in decode(" ".join(run), model.chars).split()]).sum())
            if len(run) <= KEPT_RUN and len(memo) < KEPT_RUNS:
                memo[run] = value
        return value

    def of(column: pa.Array) -> np.ndarray:
        sums, runs = np.zeros((len(column), 2)), _Runs()
        for lo, rows, found, values, _ in table.texts(column):
            add_rows(sums, lo, rows, values)
            for row, run in runs.of(lo, rows, found):
                sums[row, 0] += value_of(run)
        for row, run in runs.rest():
            sums[row, 0] += value_of(run)
        return sums

    return of


def _feature_counts(chars: CharModel):
    """(text, toxic) to (hash of a feature, numbers of toxic and of other texts that have it), in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        counts: tuple[dict[int, int], dict[int, int]] = ({}, {})

        def part() -> pa.RecordBatch:
            names = np.array([*counts[1], *counts[0]], np.uint64).view(np.int64)
            n = np.array([*counts[1].values(), *counts[0].values()], np.int64)
            bad = np.arange(len(n)) < len(counts[1])
            out = pa.RecordBatch.from_arrays([pa.array(names), pa.array(n * bad), pa.array(n * ~bad)], names=["h", "bad", "good"])
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, into, seen = set(text.split()), counts[toxic > 0], set()
                if len(known) > KEPT_FEATURES:
                    known.clear()
                new = [w for w in words if w not in known]
                made = [[f for w in restore_word(word, chars) for f in features(w)] for word in new]
                flat, at = _hashes([f for m in made for f in m]).tolist(), 0
                for word, m in zip(new, made):
                    known[word] = tuple(flat[at : at + len(m)])
                    at += len(m)
                for word in words:
                    seen.update(known[word])
                for h in seen:
                    into[h] = into.get(h, 0) + 1
                if len(counts[0]) + len(counts[1]) > KEPT_FEATURES:
                    yield part()
        yield part()
        known.clear()
        trim()

    return run


def _learn_evidence(rows: DataFrame, chars: CharModel, bad: int, good: int, scratch: Scratch) -> Evidence:
    """The evidence of all features of rows (_text, _toxic) that are in LEAST_TEXTS toxic texts and weigh LEAST_EVIDENCE; counted, filtered and stored by tasks."""
    counted = rows.select("_text", "_toxic").mapInArrow(_feature_counts(chars), "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    passed = scratch.save(counted.filter(F.col("bad") >= LEAST_TEXTS).select("h", weight.alias("w")).filter(F.col("w") >= LEAST_EVIDENCE), "features")
    files = max(LEAST_FILES, -(-passed.count() // FILE_FEATURES))
    place = F.shiftright(F.shiftrightunsigned("h", 40) * F.lit(files).cast("long"), 24).cast("int")
    stored = scratch.save(passed.withColumn("b", place).groupBy("b").applyInArrow(_store_evidence(scratch.path("evidence")), "b int, uri string, rows long"), "evidence-files")
    found = {r["b"]: r for r in stored.collect()}
    scratch.drop("features", "evidence-files")
    return Evidence([found[b]["uri"] if b in found else "" for b in range(files)], [found[b]["rows"] if b in found else 0 for b in range(files)])


def fit(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, learn) -> ToxicityModel:
    """Learn a model: characters from all texts of docs, evidence from every labelled text among those for which learn holds.

    learn is a condition on docs. A text that bears both labels counts under both. The three
    weights of the score are fitted on at most FIT_TEXTS labelled texts, taken by a hash of the key.
    Null labels and texts teach nothing.
    """
    chars = CharModel.fit(docs, text)
    marked = labels.select(F.col(label_key).alias("_k"), F.col(label).cast("int").alias("_toxic")).filter("_toxic is not null").distinct()
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = docs.filter(learn).select(F.col(key).alias("_k"), F.col(text).alias("_text")).filter("_text is not null")
    rows = scratch.save(likely(texts, "_k", marked).join(marked, "_k"), "labelled")
    sizes = {r["_toxic"] > 0: r["n"] for r in rows.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    model = ToxicityModel(chars, Evidence([], []), (-10.0, 0.0, 0.0))
    if not bad or not good:
        return model
    model.evidence = _learn_evidence(rows, chars, bad, good, scratch)
    few = min(1.0, 1.5 * FIT_TEXTS / (bad + good))
    sample = rows.filter(F.pmod(F.xxhash64("_k"), F.lit(1 << 20)) < int(few * (1 << 20))).limit(FIT_TEXTS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _text_sums(model)
        for batch in batches:
            s = of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1]), batch.column(1)], names=["evidence", "words", "toxic"])

    got = sample.select("_text", "_toxic").mapInArrow(sums, "evidence double, words double, toxic int").collect()
    x = model.inputs(np.array([[r["evidence"], r["words"]] for r in got]))
    scratch.drop("labelled")
    model.weights = _logistic(x, np.array([float(r["toxic"] > 0) for r in got]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge; the slopes are kept from falling below zero."""
    w, use = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    for _ in range(2):
        w[:] = 0
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            ridge = np.diag([1e-6, *[1e-3 * len(y) ** 0.5] * (x.shape[1] - 1)])
            g = x.T @ (p - y) + ridge @ w
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge
            step = np.zeros_like(w)
            step[use] = np.linalg.solve(h[np.ix_(use, use)] + 1e-9 * np.eye(use.sum()), g[use])
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        negative = (w < 0) & (np.arange(len(w)) > 0)
        if not negative.any():
            break
        use &= ~negative
    return tuple(float(v) for v in w)


def score_texts(docs: DataFrame, key: str, text: str, model: ToxicityModel) -> DataFrame:
    """The toxicity of every whole text: columns key, score (0 to 1), evidence, words.

    Null and empty texts have no words and the score of a text without evidence. Null keys and
    repeated rows keep a row each; an empty table gives no rows; only the two columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _text_sums(model)
        for batch in batches:
            s = of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(s)), pa.array(s[:, 0]), pa.array(s[:, 1])], names=["key", "score", "evidence", "words"])
        del of
        trim()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double, evidence double, words double").withColumnRenamed("key", key)


def restore_texts(docs: DataFrame, key: str, text: str, chars: CharModel) -> DataFrame:
    """Columns key, restored: whole texts with disguises undone (null stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if (t := v.as_py()) is None else restore_text(t, chars) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "restored"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, restored string").withColumnRenamed("key", key)


def drop_toxic(docs: DataFrame, text: str, model: ToxicityModel, threshold: float) -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold; null and empty texts stay unless the model rejects all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _text_sums(model)
        for batch in batches:
            yield batch.filter(pa.array(model.score(of(batch.column(batch.schema.names.index(text)))) < threshold))
        del of
        trim()

    return docs.mapInArrow(run, docs.schema)
