"""Sums over the words of whole texts, where each distinct word is computed once.

A worker keeps the values of words it has met, as sorted hashes beside rows of numbers. Only words
that it does not hold are computed, all new words of a slice at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from evigraph.llm import bytescan

#: Distinct words whose values a worker keeps; beyond it the store starts anew.
KEPT_WORDS = 1_500_000
SLICE_BYTES = 2 << 20
#: Words with more numbers than these are kept and sliced by fewer, in proportion.
USUAL_WIDTH = 64


class WordTable:
    """Values of words: ``compute`` takes words as bytes (A-Z lowered) and returns a row of numbers for each."""

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], width: int):
        self.compute, self.width = compute, width
        self.hashes, self.values = np.empty(0, np.uint64), np.empty((0, width), np.float32)
        wide = max(USUAL_WIDTH, width)
        self.kept, self.slice = KEPT_WORDS * USUAL_WIDTH // wide, max(1, SLICE_BYTES * USUAL_WIDTH // wide)

    def rows(self, found: bytescan.Words) -> np.ndarray:
        """The values of every word, in order."""
        names, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, names)
        at[at == len(self.hashes)] = 0
        have = self.hashes[at] == names if len(self.hashes) else np.zeros(len(names), bool)
        if not have.all():
            new = np.flatnonzero(~have)
            raw = found.data.tobytes()
            values = self.compute([raw[a:b] for a, b in zip(found.starts[first[new]], found.ends[first[new]])]).astype(np.float32).reshape(len(new), self.width)
            if len(self.hashes) + len(new) > self.kept:
                keep = np.flatnonzero(have)
                self.hashes, self.values = names[keep], self.values[at[keep]]
            hashes = np.concatenate([self.hashes, names[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.values = hashes[order], np.concatenate([self.values, values])[order]
            at = np.searchsorted(self.hashes, names)
        return self.values[at][back]

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, bytescan.Words, np.ndarray, np.ndarray]]:
        """Slices of a column: (first row, row number of each word, words, values of each word, row ends in bytes).

        A text longer than a slice comes in several slices, cut at white space.
        """
        data, offsets = bytescan.buffers(column)
        for lo, hi in bytescan.runs(offsets, self.slice):
            begin, end = int(offsets[lo]), int(offsets[hi])
            while begin < end:
                stop = min(end, begin + 2 * self.slice)
                while stop < end and not bytescan._SPACE[data[stop]]:
                    stop += 1
                cuts = np.clip(offsets[lo : hi + 1] - begin, 0, stop - begin)
                found = bytescan.words(data[begin:stop], cuts)
                if len(found.starts):
                    yield lo, np.searchsorted(cuts, found.starts, "right") - 1, found, self.rows(found), cuts
                begin = stop


def add_rows(into: np.ndarray, lo: int, rows: np.ndarray, values: np.ndarray) -> None:
    """Add the values of words to those of their texts; rows is ascending."""
    if len(rows):
        cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        into[lo + rows[cut]] += np.add.reduceat(values.astype(np.float64), cut, axis=0)
