"""Phrase collocations from count tries of bounded depth.

Two scans of the texts. The first counts words for each language; a word below the least count
can't be in any phrase, so it ends phrases like a mark does, and the others get numbers in the
order of their hashes. The second builds in each shard a trie of phrases, kept as one sorted array
a level, and cuts it into prefix ranges. The tries of one range are merged, sorted runs by sorted
runs. A walk from the root gives the counts of a phrase's left parts; its suffix link (the phrase
without its first word) gives those of its right parts.

Words are told apart by 64-bit hashes of language and word; two words of one hash are an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm import spans
from evigraph.llm.bytescan import chain, mix
from evigraph.llm.kneser_ney import _write, mapped, pack, unpack
from evigraph.llm.shared import Scratch

#: Bytes that end a piece, and those that only end a word.
MARKS = [ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))
BLANKS = [0x20, 0x09]
LEAST, LONGEST, TOP, COVERED_PERCENT = 10, 3, 2000, 50
UNKNOWN = "und"
#: Tokens that a shard holds before it gives its trie away; phrases of a prefix range, as gathered.
GATHER, RANGE = 2_000_000, 2_000_000
#: Parts that a language's phrases are cut into before its best are chosen.
SALTS = 64

_LOWER = spans.table(MARKS + BLANKS)
_BREAK = _LOWER == spans.SPACE
_MARK = np.zeros(256, bool)
_MARK[MARKS] = True


def _lang_hash(lang: bytes) -> np.uint64:
    data = np.frombuffer(lang, np.uint8)
    return mix(spans.hashes(data, np.zeros(1, np.int64), np.array([len(data)]))) [0]


def _entry(lang: bytes, word: bytes) -> bytes:
    return struct.pack("<I", len(lang)) + lang + word


def _split(entry: bytes) -> tuple[str, bytes]:
    n = struct.unpack_from("<I", entry)[0]
    return entry[4 : 4 + n].decode(), entry[4 + n :]


class Stream:
    """Words of (lang, text) batches in order: hash of language and word, and the piece each word is in."""

    def __init__(self):
        self.piece, self.langs = 0, {}

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
        """(hashes, pieces, starts, ends, lowered bytes, languages of the batch, index of each word's language)."""
        names = batch.column(0).dictionary_encode()
        langs = [x.encode() for x in names.dictionary.to_pylist()]
        for x in langs:
            if x not in self.langs:
                self.langs[x] = _lang_hash(x)
        by_lang = np.array([self.langs[x] for x in langs], np.uint64)
        of_row = names.indices.to_numpy(zero_copy_only=False)
        row_before = -1
        for lo, data, cuts in spans.slices(batch.column(1), _BREAK):
            low = _LOWER[data]
            starts, ends = spans.words(low, cuts)
            rows = lo + spans.rows_of(cuts, starts)
            lang = of_row[rows]
            marks = np.cumsum(_MARK[data])
            # every text begins a piece of its own; a text that goes on from the last slice keeps its piece
            first = lo if lo > row_before else row_before
            pieces = self.piece + (marks[starts] if len(starts) else 0) + (rows - first + (lo > row_before))
            self.piece = self.piece + (int(marks[-1]) if len(marks) else 0) + (lo + len(cuts) - 2 - first + (lo > row_before))
            row_before = lo + len(cuts) - 2
            if len(starts):
                yield chain(by_lang[lang], spans.hashes(low, starts, ends)), pieces, starts, ends, low, langs, lang
        self.piece += 1


@dataclass
class Words:
    """Words of at least the least count, in files by the leading bits of their hashes: hashes, counts, running totals, entries."""

    bits: int
    uris: list[str]
    rows: list[int]
    base: list[int]
    before: list[int]  # counts in the files before
    total: int

    @property
    def size(self) -> int:
        return self.base[-1] + self.rows[-1] if self.rows else 0

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers (-1: too rare) of sorted distinct hashes."""
        out = np.full(len(hashes), -1, np.int64)
        cut = np.append(np.searchsorted(hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)), len(hashes))
        for b in np.flatnonzero(np.diff(cut)):
            if self.rows[b]:
                part = slice(cut[b], cut[b + 1])
                held = mapped(f"{self.uris[b]}.h", np.uint64, self.rows[b])
                at = np.searchsorted(held, hashes[part])
                at[at == self.rows[b]] = 0
                out[part] = np.where(held[at] == hashes[part], at + self.base[b], -1)
        return out

    def _by_file(self, numbers: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        cut = np.append(np.searchsorted(numbers, self.base), len(numbers))
        for b in np.flatnonzero(np.diff(cut)):
            yield b, slice(cut[b], cut[b + 1]), numbers[cut[b] : cut[b + 1]] - self.base[b]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of sorted numbers."""
        out = np.zeros(len(numbers), np.int64)
        for b, part, at in self._by_file(numbers):
            out[part] = mapped(f"{self.uris[b]}.n", np.int64, self.rows[b])[at]
        return out

    def shares(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shares of all words before and up to sorted numbers."""
        own, before = self.counts(numbers), np.zeros(len(numbers), np.int64)
        for b, part, at in self._by_file(numbers):
            before[part] = mapped(f"{self.uris[b]}.m", np.int64, self.rows[b])[at] + self.before[b]
        return before / max(1, self.total), (before + own) / max(1, self.total)

    def entries(self, numbers: np.ndarray) -> list[bytes]:
        """Language and word of sorted numbers."""
        out: list[bytes] = []
        for b, _, at in self._by_file(numbers):
            ends = mapped(f"{self.uris[b]}.e", np.int64, self.rows[b])
            held = mapped(f"{self.uris[b]}.w", np.uint8, int(ends[-1]))
            lo = np.where(at > 0, ends[np.maximum(at - 1, 0)], 0)
            out += [held[a:z].tobytes() for a, z in zip(lo, ends[at])]
        return out


class _Counter:
    """Counts and entries of the words a task has met, in sorted arrays; new words wait until there are many."""

    def __init__(self):
        self.names, self.counts, self.entries = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, object)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, entry) -> None:
        """Count hashes; entry gives the entries of the words at some places."""
        names, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            old = self.names[at] == names
            self.counts[at[old]] += counts[old]
            names, first, counts = names[~old], first[~old], counts[~old]
        entries = np.empty(len(names), object)
        entries[:] = entry(first)
        self.waiting.append((names, counts, entries))
        self.size += len(names)
        if self.size - len(self.names) > 200_000 + len(self.names) // 4:
            self.settle()

    def settle(self) -> None:
        parts = [(self.names, self.counts, self.entries), *self.waiting]
        names, counts, entries = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.names, first, back = np.unique(names, return_index=True, return_inverse=True)
        self.counts, self.entries = np.bincount(back, counts).astype(np.int64), entries[first]
        self.waiting, self.size = [], len(self.names)


def _count_words(bits: int):
    """(lang, text) to rows (b, k, n, l, w): packed hashes, counts, lengths and entries of a hash range; and rows (lang, words) of totals."""
    columns = ["b", "k", "n", "l", "w", "lang", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held = Stream(), _Counter()
        totals: dict[bytes, int] = {}

        def part() -> pa.RecordBatch:
            names, counts, entries = held.names, held.counts, held.entries
            cut = np.append(np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(names))
            full = np.flatnonzero(np.diff(cut))
            rows = [slice(cut[b], cut[b + 1]) for b in full]
            lens = [np.array([len(x) for x in entries[r]], np.uint32) for r in rows]
            packed = [[pack(names[r]) for r in rows], [pack(counts[r]) for r in rows], [pack(x) for x in lens], [b"".join(entries[r]) for r in rows]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in packed), pa.nulls(len(full), pa.string()), pa.nulls(len(full), pa.int64())], names=columns)

        for batch in batches:
            for hashes, _, starts, ends, low, langs, lang in stream.read(batch):
                raw = low.tobytes()
                held.add(hashes, lambda at: [_entry(langs[a], raw[s:e]) for a, s, e in zip(lang[at], starts[at], ends[at])])  # noqa: B023
                for i, n in enumerate(np.bincount(lang, minlength=len(langs))):
                    if n:
                        totals[langs[i]] = totals.get(langs[i], 0) + int(n)
                if held.size > GATHER:
                    held.settle()
                    if held.size > GATHER // 2:
                        yield part()
                        held = _Counter()
        held.settle()
        if held.size:
            yield part()
        if totals:
            n = len(totals)
            blank = [pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(4))]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([x.decode() for x in totals]), pa.array(list(totals.values()), pa.int64())], names=columns)

    return run


def _store_words(root: str, least: int):
    def run(table: pa.Table) -> pa.Table:
        k = np.concatenate([unpack(x, np.uint64) for x in table.column("k").to_pylist()])
        n = np.concatenate([unpack(x, np.int64) for x in table.column("n").to_pylist()])
        ends = np.cumsum(np.concatenate([unpack(x, np.uint32) for x in table.column("l").to_pylist()]).astype(np.int64))
        raw = b"".join(table.column("w").to_pylist())
        names, back = np.unique(k, return_inverse=True)
        counts = np.bincount(back, n).astype(np.int64)
        usual = counts >= least
        keep = np.flatnonzero(usual[back])
        entries: dict[int, bytes] = {}
        for i in keep:
            entry = raw[ends[i - 1] if i else 0 : ends[i]]
            if entries.setdefault(back[i], entry) != entry:
                raise ValueError("two words share a 64-bit hash")
        names, counts = names[usual], counts[usual]
        words = [entries[i] for i in np.flatnonzero(usual)]
        arrays = {"h": names, "n": counts, "m": np.cumsum(counts) - counts, "e": np.cumsum(np.array([len(w) for w in words], np.int64)), "w": np.frombuffer(b"".join(words), np.uint8)}
        uri = _write(root, arrays)
        return pa.table({"b": pa.array([table.column("b")[0].as_py()], pa.int32()), "uri": [uri], "rows": pa.array([len(names)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    return run


def count_words(texts: DataFrame, scratch: Scratch, least: int) -> tuple[Words, DataFrame]:
    """Words of (lang, text) with at least ``least`` occurrences in their language, and a table (lang, n) of all occurrences."""
    bits = max(3, (max(1, texts.rdd.getNumPartitions()) - 1).bit_length())
    counted = scratch.save(texts.mapInArrow(_count_words(bits), "b int, k binary, n binary, l binary, w binary, lang string, words long"), "counted")
    shards = counted.filter("b is not null").select("b", "k", "n", "l", "w")
    stored = scratch.save(shards.groupBy("b").applyInArrow(_store_words(scratch.path("words"), least), "b int, uri string, rows long, tokens long"), "word-files")
    totals = scratch.save(counted.filter("b is null").groupBy("lang").agg(F.sum("words").alias("n")), "totals")
    scratch.drop("counted")
    found = {r["b"]: r for r in stored.collect()}  # one row a file
    uris, rows, tokens = ([found[b][c] if b in found else d for b in range(1 << bits)] for c, d in (("uri", ""), ("rows", 0), ("tokens", 0)))
    if sum(rows) >= 1 << 32:
        raise ValueError("more words than 32-bit numbers")
    return Words(bits, uris, rows, [0, *np.cumsum(rows).tolist()][:-1], [0, *np.cumsum(tokens).tolist()][:-1], sum(tokens)), totals


@dataclass
class Trie:
    """Levels 2 to the longest: each node's parent (its place in the level above; at level 2 the first word), word and count; nodes are sorted."""

    parents: list[np.ndarray]
    words: list[np.ndarray]
    counts: list[np.ndarray]


def _keys(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    return parent.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


def build_trie(words: np.ndarray, pieces: np.ndarray, begin: int, longest: int) -> Trie:
    """The trie of phrases that start at words[:begin]; words after these only continue them. Words below 0 end phrases."""
    trie = Trie([], [], [])
    at = np.flatnonzero(words[:begin] >= 0)
    parent = words[at]
    for n in range(1, longest):
        ok = at + n < len(words)
        at, parent = at[ok], parent[ok]
        ok = (words[at + n] >= 0) & (pieces[at + n] == pieces[at])
        at, parent = at[ok], parent[ok]
        keys, back, counts = np.unique(_keys(parent, words[at + n]), return_inverse=True, return_counts=True)
        trie.parents.append((keys >> np.uint64(32)).astype(np.int64))
        trie.words.append((keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
        trie.counts.append(counts.astype(np.int64))
        parent = back
    return trie


def merge_tries(tries: list[Trie]) -> Trie:
    """One trie of the summed counts: level by level, the sorted runs of all tries become one."""
    out = Trie([], [], [])
    moved: list[np.ndarray] = []  # for each trie, where its nodes of the level above went
    for level in range(len(tries[0].words)):
        parents = [t.parents[0] for t in tries] if level == 0 else [m[t.parents[level]] for m, t in zip(moved, tries)]
        runs = [_keys(p, t.words[level]) for p, t in zip(parents, tries)]
        both = np.concatenate(runs)
        order = np.argsort(both, kind="stable")  # merges the runs that are sorted already
        keys = both[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        place = np.empty(len(both), np.int64)
        place[order] = np.cumsum(first) - 1
        total = np.bincount(place, np.concatenate([t.counts[level] for t in tries]), minlength=int(first.sum())).astype(np.int64)
        names = keys[first]
        out.parents.append((names >> np.uint64(32)).astype(np.int64))
        out.words.append((names & np.uint64(0xFFFFFFFF)).astype(np.int64))
        out.counts.append(total)
        moved = np.split(place, np.cumsum([len(r) for r in runs])[:-1])
    return out


def _range_cuts(trie: Trie, words: Words, ranges: int) -> list[np.ndarray]:
    """The prefix range of each node: its place among all phrases, were words independent; deeper nodes go by their first three words."""

    def shares(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, back = np.unique(w, return_inverse=True)
        lo, hi = words.shares(names)
        return lo[back], hi[back]

    def within(lo: np.ndarray, hi: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.minimum(lo + (hi - lo) * share, hi)  # rounding never leaves the parent's place

    def of(place: np.ndarray) -> np.ndarray:
        return np.minimum((place * ranges).astype(np.int64), ranges - 1)

    lo1, hi1 = shares(trie.parents[0])
    lo2, hi2 = shares(trie.words[0])
    begin, end = within(lo1, hi1, lo2), within(lo1, hi1, hi2)
    out = [of(begin)]
    for level in range(1, len(trie.words)):
        up = trie.parents[level]
        out.append(of(within(begin[up], end[up], shares(trie.words[1])[0])) if level == 1 else out[level - 1][up])
    return out


def cut_trie(trie: Trie, words: Words, ranges: int) -> Iterator[tuple[int, list[bytes]]]:
    """(range, packed levels). Ancestors in an earlier range come along with a count of 0."""
    of = _range_cuts(trie, words, ranges)
    for r in np.flatnonzero(np.bincount(np.concatenate(of), minlength=ranges)):
        lo_hi, below = [None] * len(of), None
        for level in range(len(of) - 1, -1, -1):
            lo, hi = np.searchsorted(of[level], [r, r + 1])
            own = (int(lo), int(hi))
            if below is not None and below[1] > below[0]:
                up = trie.parents[level + 1]
                a, z = int(up[below[0]]), int(up[below[1] - 1]) + 1
                lo, hi = (a, z) if hi <= lo else (min(lo, a), max(hi, z))
            lo_hi[level] = (int(lo), int(hi), own)
            below = (int(lo), int(hi))
        parts: list[bytes] = []
        for level, (lo, hi, own) in enumerate(lo_hi):
            counts = trie.counts[level][lo:hi].copy()
            counts[: max(0, own[0] - lo)] = 0
            counts[max(0, own[1] - lo) :] = 0
            parent = trie.parents[level][lo:hi] - (lo_hi[level - 1][0] if level else 0)
            parts += [pack(x) if len(x) else b"" for x in (parent.astype(np.uint32), trie.words[level][lo:hi].astype(np.uint32), counts)]
        yield int(r), parts


def _load(parts: list[bytes]) -> Trie:
    kinds = (np.uint32, np.uint32, np.int64)
    columns = [[unpack(p, kind).astype(np.int64) if p else np.empty(0, np.int64) for p in parts[i::3]] for i, kind in enumerate(kinds)]
    return Trie(*columns)


def _shards(words: Words, ranges: int, longest: int):
    """(lang, text) to (range, packed trie)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held, size = Stream(), [], 0

        def part(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            hashes, pieces = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            names, back = np.unique(hashes, return_inverse=True)
            number = words.numbers(names)[back]
            keep = 0 if last else min(longest - 1, len(number))
            trie = build_trie(number, pieces, len(number) - keep, longest)
            if len(trie.words[0]):
                for r, parts in cut_trie(trie, words, ranges):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([parts], pa.list_(pa.binary()))], names=["r", "t"])
            held = [(hashes[len(hashes) - keep :], pieces[len(pieces) - keep :])] if keep else []
            size = keep

        for batch in batches:
            for hashes, pieces, *_ in stream.read(batch):
                held.append((hashes, pieces))
                size += len(hashes)
                if size > GATHER:
                    yield from part(False)
        if held:
            yield from part(True)

    return run


_NODES = "words array<bigint>, f long, lefts array<bigint>, last long"


def _merge_range(words: Words, least: int):
    """All tries of one range to its nodes of at least the least count.

    lefts: counts of the phrase's first 1, 2 ... words, from the walk down; null where that
    ancestor's count is in another range. last: the count of its last word.
    """

    def run(table: pa.Table) -> pa.Table:
        trie = merge_tries([_load(p) for p in table.column("t").to_pylist()])
        out_words, out_lefts, f, last = [], [], [], []
        path = left = None
        for level in range(len(trie.words)):
            up, word, count = trie.parents[level], trie.words[level], trie.counts[level]
            if level == 0:
                names, back = np.unique(up, return_inverse=True)
                path, left = up[:, None], words.counts(names)[back][:, None]
            else:
                path, left = path[up], np.hstack([left[up], trie.counts[level - 1][up][:, None]])
            path = np.hstack([path, word[:, None]])
            keep = np.flatnonzero(count >= least)
            names, back = np.unique(word[keep], return_inverse=True)
            out_words += path[keep].tolist()
            out_lefts += [[x or None for x in row] for row in left[keep].tolist()]
            f += count[keep].tolist()
            last += words.counts(names)[back].tolist() if len(keep) else []
        longs = pa.list_(pa.int64())
        return pa.table({"words": pa.array(out_words, longs), "f": pa.array(f, pa.int64()), "lefts": pa.array(out_lefts, longs), "last": pa.array(last, pa.int64())})

    return run


def count_phrases(texts: DataFrame, words: Words, scratch: Scratch, least: int, longest: int) -> DataFrame:
    """Phrases of 2 to ``longest`` words with at least ``least`` occurrences, with the counts of all their parts.

    Columns: words (numbers), f, lefts[k] and rights[k]: counts of the first k + 1 words and of the rest.
    """
    ranges = max(8, -(-words.total // RANGE))
    shards = texts.mapInArrow(_shards(words, ranges, longest), "r int, t array<binary>")
    nodes = scratch.save(shards.groupBy("r").applyInArrow(_merge_range(words, least), _NODES), "nodes").withColumn("n", F.size("words"))
    level = nodes.filter("n = 2").select("words", "f", "lefts", F.array("last").alias("rights"))
    pairs, out = level, level
    for n in range(3, longest + 1):
        here = nodes.filter(F.col("n") == n).drop("n")
        # a pair whose phrases lie in several ranges is counted in the first of these
        pair = pairs.select(F.col("words").alias("pair"), F.col("f").alias("pair_f"))
        away = F.expr("exists(lefts, x -> x is null)")
        mended = here.filter(away).withColumn("pair", F.slice("words", 1, 2)).join(pair, "pair").withColumn("lefts", F.transform("lefts", lambda x: F.coalesce(x, F.col("pair_f"))))
        here = here.filter(~away).unionByName(mended.select(here.columns))
        suffix = level.select(F.col("words").alias("suffix"), F.col("f").alias("suffix_f"), F.col("rights").alias("suffix_rights"))
        linked = here.withColumn("suffix", F.slice("words", 2, n - 1)).join(suffix, "suffix")
        level = linked.select("words", "f", "lefts", F.concat(F.array("suffix_f"), "suffix_rights").alias("rights"))
        out = out.unionByName(level)
    return out


def _whole(c: Column) -> Column:
    return c.cast("decimal(15,0)")


def weakest_cut(f: Column, lefts: Column, rights: Column) -> Column:
    """struct(score, k, l, r) of the cut of the lowest floor(1000000 f f / (l r)), ties to the first; exact up to counts of 10^15."""

    def cut(l_count: Column, i: Column) -> Column:
        r_count = F.element_at(rights, i + 1)
        top = F.lit(1_000_000).cast("decimal(7,0)") * (_whole(f) * _whole(f))
        score = F.call_function("div", top, _whole(l_count) * _whole(r_count)).cast("long")
        return F.struct(score.alias("score"), (i + 1).alias("k"), l_count.alias("l"), r_count.alias("r"))

    return F.array_min(F.transform(lefts, cut))


def _name(words: Words):
    """Numbers of words to language and phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0)
            flat, cuts = numbers.flatten().to_numpy(), np.r_[0, np.cumsum(numbers.value_lengths().to_numpy())]
            names, back = np.unique(flat, return_inverse=True)
            held = [_split(e) for e in words.entries(names)]
            phrases = [b" ".join(held[i][1] for i in back[a:z]).decode() for a, z in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([held[back[a]][0] for a in cuts[:-1]], pa.string()), pa.array(phrases, pa.string()), *batch.columns[1:]], names=["lang", "phrase", *batch.schema.names[1:]])

    return run


def find_collocations(docs: DataFrame, text: str, lang: str, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED_PERCENT) -> DataFrame:
    """The phrases whose parts go together most, in every language.

    Columns: lang, rank (from 1), phrase, a, l, r, n, score, words (how many). A null language is
    UNKNOWN, a null text empty. Phrases have 2 to ``longest`` words and at least ``least``
    occurrences a. A phrase is scored by its weakest cut. Phrases inside a longer one of at least
    ``covered`` percent of their occurrences are dropped; it is enough to look one word further, as
    any longer phrase's own parts occur as often as itself. Each language keeps its first ``top``
    by falling score, falling a and rising phrase. Repeated rows count each; an empty table gives no
    rows; only the two named columns are read.
    """
    if not 2 <= longest or least < 1:
        raise ValueError("phrases have at least two words and occur")
    scratch = Scratch(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    words, totals = count_words(texts, scratch, least)
    found = scratch.save(count_phrases(texts, words, scratch, least, longest), "phrases")
    sides = [F.slice("words", F.lit(start), F.size("words") - 1) for start in (1, 2)]
    parts = found.filter(F.size("words") > 2).select("f", F.explode(F.array_distinct(F.array(*sides))).alias("words")).groupBy("words").agg(F.max("f").alias("longer"))
    kept = found.join(parts, "words", "left").filter(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True)))
    cut = weakest_cut(F.col("f"), F.col("lefts"), F.col("rights"))
    scored = kept.select("words", F.col("f").alias("a"), cut.alias("c")).select("words", "a", "c.l", "c.r", "c.score", F.size("words").alias("n_words"))
    named = scratch.save(scored.mapInArrow(_name(words), "lang string, phrase string, a long, l long, r long, score long, n_words int"), "named")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    out = best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("n_words").alias("words"))
    return out
