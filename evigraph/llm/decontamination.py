"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is split into k + 1 pieces. A passage within k edits of the
item must hold at least one piece unchanged, so an automaton over all pieces finds every place
worth a look. Each place is then verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.shared import Scratch

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 12
#: Characters of test items that one automaton holds; larger benchmarks are matched in blocks.
BLOCK_CHARS = 4_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str) -> str:
    """Lower case, ASCII punctuation and controls as space, runs of white space as one space."""
    folded = text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass")
    return " ".join(folded.split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length that make up the item."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of text nearest to item, the first such; None if beyond the budget.

    Bit-parallel: each column of the table of differences is two integers of len(item) bits. The
    top row is zero, so a passage may begin anywhere.
    """
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    get = masks.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | ~(d | plus) & full
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | ~(d | up) & full
        minus = up & d
        if score <= budget and (best is None or score < best[0]):
            best = score, at + 1
            if not score:
                break
    return best


class Matcher:
    """All places where one of the items occurs within its budget."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items = [(key, norm, len(norm) // chars_per_edit) for key, text in items if (norm := normalise(text))]
        #: Twice as many, shorter pieces: k edits spoil at most k of them, so k + 2 must be left.
        self.halves = [[p for _, p in pieces(norm, 2 * budget + 1)] for _, norm, budget in self.items]
        self.automaton = ahocorasick.Automaton()
        starts: dict[str, list[tuple[int, int]]] = {}
        for k, (_, norm, budget) in enumerate(self.items):
            # an item without a budget is looked up as whole words
            parts = [(-1, f" {norm} ")] if budget == 0 else pieces(norm, budget)
            for offset, piece in parts:
                starts.setdefault(piece, []).append((k, offset))
        for piece, where in starts.items():
            self.automaton.add_word(piece, (len(piece), where))
        if starts:
            self.automaton.make_automaton()
        self.empty = not starts

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item key, distance, budget, end in the normalised text), the nearest passage of each item."""
        if self.empty or not text:
            return []
        body = f" {normalise(text)} "
        at: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(body):
            for k, offset in where:
                at.setdefault(k, []).append(end + 1 - size - offset)
        out = []
        for k, places in at.items():
            key, norm, budget = self.items[k]
            if budget == 0 or norm in body:
                out.append((key, 0, budget, body.find(norm) + len(norm)))
                continue
            best, done = None, -1
            for place in sorted(places):
                if place + budget <= done:
                    continue
                lo, hi = max(0, place - budget), place + len(norm) + 2 * budget
                window = body[lo:hi]
                hit = myers(norm, window, budget) if sum([h in window for h in self.halves[k]]) >= budget + 2 else None
                done = place + budget if hit is None else done
                if hit is not None and (best is None or hit[0] < best[0]):
                    best = hit[0], lo + hit[1]
            if best is not None:
                out.append((key, best[0], budget, best[1]))
        return out


@lru_cache(4)
def _matcher(items: tuple[tuple[int, str], ...], chars_per_edit: int) -> Matcher:
    return Matcher(list(items), chars_per_edit)


def _match(items: tuple[tuple[int, str], ...], chars_per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, chars_per_edit)
        for batch in batches:
            rows = [(key.as_py(), *hit) for key, text in zip(batch.column(0), batch.column(1)) for hit in matcher.find(text.as_py() or "")]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["key", "item", "distance", "budget", "end"]
            )

    return run


def _items(benchmark: DataFrame, item_key: str | None, item_text: str) -> Iterator[tuple[tuple[int, str], ...]]:
    """Distinct test items in blocks of about BLOCK_CHARS characters; one empty block if there are none. Without a key, items are told apart by their texts."""
    items = benchmark.select((F.col(item_key).cast("long") if item_key else F.xxhash64(item_text)).alias("k"), F.col(item_text).alias("t")).filter("k is not null and t is not null").distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    for b in range(blocks):
        yield tuple((r["k"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).sort("k", "t").collect())


def find_leaks(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item_key: str, item_text: str, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Every pair of a text and a test item that occurs in it within the item's budget.

    Columns: key, item_id, distance (of the nearest passage), budget, end (of that passage, in the
    normalised text). Case, ASCII punctuation and white space do not count as edits. Items without
    a key are not looked for; items of fewer than ``chars_per_edit`` characters have no budget and are found as whole words; items that are
    null or empty once normalised match nothing, as do null and empty texts. Texts are matched
    whole. Repeated rows repeat their pairs; repeated items are matched once. Test items are held
    in memory in blocks of BLOCK_CHARS characters, one pass over the texts a block. Empty tables
    give no rows; only the named columns are read.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("text is not null and text <> ''")
    schema, out = "key long, item long, distance int, budget int, end long", None
    for held in _items(benchmark, item_key, item_text):
        part = rows.mapInArrow(_match(held, chars_per_edit), schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("key").alias(key), F.col("item").alias("item_id"), "distance", "budget", "end")


def drop_leaks(docs: DataFrame, text: str, benchmark: DataFrame, item_text: str, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The rows of docs, all columns, whose text holds no test item within its budget; null and empty texts stay.

    Items need no key. One block of items is held at a time: what a block leaves is written before
    the next one.
    """
    scratch, out = Scratch(docs.sparkSession, "leaks"), None
    for k, held in enumerate(_items(benchmark, None, item_text)):
        left = docs if out is None else scratch.save(out, f"block{k}")
        out = left.mapInArrow(_dropper(held, text, chars_per_edit), docs.schema)
    return out


def _dropper(held: tuple[tuple[int, str], ...], text: str, chars_per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(held, chars_per_edit)
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            yield batch.filter(pa.array([not matcher.find(t.as_py() or "") for t in column], pa.bool_()))

    return run
