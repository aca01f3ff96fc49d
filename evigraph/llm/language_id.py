"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word (a run of bytes without white space) from both ends and labels every byte.
Of a word of more than MAX_BYTES, pieces cut between characters are labelled, each read with
MAX_BYTES of the word on either side. Its state does not cross white space, so equal words get
equal labels and are computed once. A text's probabilities are the mean over all its labelled
bytes. Training is by backpropagation through time in numpy, on the driver, from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.wordtable import WordTable, add_rows

#: Texts of each language in the training sample, and bytes of each of these texts.
TRAIN_TEXTS, TRAIN_BYTES = 200, 4000
#: Beyond so many languages, training takes more steps, in proportion, and fewer texts a language, but LEAST_TEXTS.
USUAL_LANGUAGES, LEAST_TEXTS = 64, 10
MAX_BYTES = 24
HIDDEN, STEPS, BATCH, RATE, SEED = 12, 500, 384, 0.02, 11
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters: for each direction x (256 x 3H, what a byte adds to the gates) and u (H x 3H); out (2H x C), bias (C)."""

    x: np.ndarray
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    labels: list[str]

    @staticmethod
    def new(labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        return Network(
            rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
            rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(np.float32),
            rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32),
            np.zeros(len(labels), np.float32),
            labels,
        )

    def _scan(self, d: int, codes: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States of one direction after each byte (L x B x H); codes is L x B in reading order."""
        h = self.u.shape[1]
        state = np.zeros((codes.shape[1], h), np.float32)
        states = np.empty((*codes.shape, h), np.float32)
        for t in range(len(codes)):
            a = self.x[d][codes[t]]
            b = state @ self.u[d]
            gates = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            new = n + z * (state - n)
            if tape is not None:
                tape.append((state, z, r, n, b[:, 2 * h :]))
            states[t] = state = new
        return states

    def label(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities of every position (L x B x C) of words of one length (codes L x B)."""
        both = np.concatenate([self._scan(0, codes), self._scan(1, codes[::-1])[::-1]], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=2, keepdims=True)

    def loss_and_gradients(self, codes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients for x, u, out, bias."""
        h, (steps, size) = self.u.shape[1], codes.shape
        tapes = ([], [])
        both = np.concatenate([self._scan(0, codes, tapes[0]), self._scan(1, codes[::-1], tapes[1])[::-1]], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        loss = float(-np.log(p[:, np.arange(size), target] + 1e-12).mean())
        p[:, np.arange(size), target] -= 1
        p /= steps * size
        g_out = both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2])
        g_bias = p.sum(axis=(0, 1))
        g_both = p @ self.out.T
        g_x, g_u = np.zeros_like(self.x), np.zeros_like(self.u)
        for d in (0, 1):
            order = codes if d == 0 else codes[::-1]
            into = g_both[:, :, :h] if d == 0 else g_both[::-1, :, h:]
            carry = np.zeros((size, h), np.float32)
            for t in range(steps - 1, -1, -1):
                state, z, r, n, bn = tapes[d][t]
                g = into[t] + carry
                g_n = g * (1 - z) * (1 - n * n)
                g_z = g * (state - n) * z * (1 - z)
                g_r = g_n * bn * r * (1 - r)
                g_a = np.concatenate([g_z, g_r, g_n], axis=1)
                g_b = np.concatenate([g_z, g_r, g_n * r], axis=1)
                np.add.at(g_x[d], order[t], g_a)
                g_u[d] += state.T @ g_b
                carry = g * z + g_b @ self.u[d].T
        return loss, [g_x, g_u, g_out, g_bias]

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Sums over its bytes of each word's label probabilities."""
        sizes = np.array([len(w) for w in words])
        out = np.zeros((len(words), len(self.labels)), np.float32)
        long = np.flatnonzero(sizes > MAX_BYTES)
        if len(long):
            self._add_long(words, long, out)
        for size in np.unique(sizes[sizes <= MAX_BYTES]):
            at = np.flatnonzero(sizes == size)
            codes = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), size)
            step = max(1, 4096 * USUAL_LANGUAGES // max(USUAL_LANGUAGES, len(self.labels)))
            for lo in range(0, len(at), step):
                out[at[lo : lo + step]] = self.label(np.ascontiguousarray(codes[lo : lo + step].T)).sum(axis=0)
        return out

    def _add_long(self, words: list[bytes], long: np.ndarray, out: np.ndarray) -> None:
        """Add the sums of long words, by windows of one size at once."""
        full = max(1, 1024 * USUAL_LANGUAGES // max(USUAL_LANGUAGES, len(self.labels)))
        held: dict[int, list[tuple[int, int, int, bytes]]] = {}

        def flush(size: int) -> None:
            rows = held.pop(size)
            codes = np.frombuffer(b"".join([r[3] for r in rows]), np.uint8).reshape(len(rows), size)
            place, begin, end = (np.array([r[k] for r in rows])[:, None] for k in range(3))
            own = (np.arange(size) >= begin) & (np.arange(size) < end)
            np.add.at(out, place[:, 0], (self.label(np.ascontiguousarray(codes.T)) * own.T[:, :, None]).sum(axis=0))

        for i in long:
            for begin, end, window in _windows(words[i]):
                rows = held.setdefault(len(window), [])
                rows.append((int(i), begin, end, window))
                if len(rows) >= full:
                    flush(len(window))
        for size in list(held):
            flush(size)


def train(words: list[tuple[bytes, int]], labels: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit a network to words and the numbers of their languages, by Adam; every language is drawn as often as any other."""
    net, rng = Network.new(labels, seed=seed), np.random.default_rng(seed)
    sizes = sorted({len(w) for w, _ in words})
    pools = {(s, c): [] for s in sizes for c in range(len(labels))}
    for w, c in words:
        pools[len(w), c].append(w)
    share = np.array([sum(len(pools[s, c]) * s for c in range(len(labels))) for s in sizes], np.float64)
    params = [net.x, net.u, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    frequency = {c: sum(len(pools[s, c]) for s in sizes) or 1 for c in range(len(labels))}
    for step in range(1, steps + 1):
        size = sizes[rng.choice(len(sizes), p=share / share.sum())]
        have = [c for c in range(len(labels)) if pools[size, c]]
        weight = np.array([len(pools[size, c]) / frequency[c] for c in have])
        target = rng.choice(have, BATCH, p=weight / weight.sum())
        chosen = b"".join([(pool := pools[size, c])[rng.integers(len(pool))] for c in target])
        codes = np.frombuffer(chosen, np.uint8).reshape(BATCH, size).T
        _, grads = net.loss_and_gradients(np.ascontiguousarray(codes), target)
        rate = RATE * min(1, step / 20) * (1 - step / (steps + 1))
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def _pieces(word: bytes, size: int) -> list[int]:
    """Bounds of pieces of a word of at most size bytes, between characters."""
    cuts = [0]
    while len(word) - cuts[-1] > size:
        end = cuts[-1] + size
        cuts.append(next((k for k in range(end, end - 4, -1) if word[k] & 0xC0 != 0x80), end))
    return [*cuts, len(word)]


def _windows(word: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, window) of each piece of a word: its place in a window that holds its neighbours too."""
    cuts = _pieces(word, MAX_BYTES)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        first, last = cuts[max(0, k - 1)], cuts[min(len(cuts) - 1, k + 2)]
        yield a - first, b - first, word[first:last]


def _split(text: bytes) -> list[bytes]:
    """Words to train on; those longer than a window in pieces of that size."""
    out = []
    for w in text.lower().split():
        cuts = _pieces(w, 3 * MAX_BYTES)
        out.extend(w[a:b] for a, b in zip(cuts, cuts[1:]))
    return out


def fit(docs: DataFrame, key: str, text: str, lang: str) -> Network | None:
    """Train on a sample: at most TRAIN_TEXTS texts of each language in docs, TRAIN_BYTES of each. Every language found is learnt.

    The sample is taken by a hash of key and text, evenly in every partition; None without any labelled text.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("t is not null and t <> '' and l is not null")
    labels = sorted(r["l"] for r in rows.select("l").distinct().collect())
    if not labels:
        return None
    many = max(1.0, len(labels) / USUAL_LANGUAGES)
    order = Window.partitionBy("l").orderBy(F.xxhash64("k", "l"), "k")
    cut = F.substring("t", 1, TRAIN_BYTES)
    sample = rows.select("k", "l", cut.alias("t")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(LEAST_TEXTS, int(TRAIN_TEXTS / many))).select("l", "t", "r").collect()
    number = {l: i for i, l in enumerate(labels)}
    words = [(w, number[r["l"]]) for r in sorted(sample, key=lambda r: (r["l"], r["r"])) for w in _split(r["t"].encode())]
    return train(words, labels, int(STEPS * many)) if words else None


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(net.word_sums, len(net.labels)) if net else None
        for batch in batches:
            n = batch.num_rows
            sums, names, score = np.zeros((n, len(net.labels) if net else 1)), [UNKNOWN] * n, np.zeros(n)
            if net:
                for lo, rows, _, values, _ in table.texts(batch.column(1)):
                    add_rows(sums, lo, rows, values)
            total = sums.sum(axis=1)
            best = sums.argmax(axis=1)
            for i, value in enumerate(batch.column(1)):
                if total[i] > 0 and any(map(str.isalpha, value.as_py())):
                    names[i], score[i] = net.labels[best[i]], min(1.0, sums[i, best[i]] / total[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["key", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, key: str, text: str, net: Network | None) -> DataFrame:
    """The language of every whole text: columns key, lang_pred, score (its pooled probability).

    Null texts and texts without a letter (and all texts, if there was nothing to learn from) are
    "und" with score 0. Null keys and repeated rows keep a row each; an empty table gives no rows.
    Only the two named columns are read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(net), f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
