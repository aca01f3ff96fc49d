"""Words of UTF-8 texts as 64-bit hashes, computed over whole byte buffers with numpy.

A word is a longest run of bytes other than space and the controls 9 to 13; A-Z are lower-cased.
These bytes never occur inside a multi-byte character, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; longer texts are cut at white space and their words joined.
SLICE_BYTES = 1 << 20

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its start and the hash of its next element."""
    return mix(left * _P + right)


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one per word
    starts: np.ndarray  # byte offset in data
    ends: np.ndarray
    data: np.ndarray  # lower-cased bytes


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), np.uint64(0x100000001B3 | 1))
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def words(data: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """Words of a byte buffer; cuts are offsets that no word crosses (starts of texts)."""
    low = _LOWER[data]
    solid = ~_SPACE[low]
    before = np.empty(len(solid) + 1, bool)
    before[0] = False
    before[1:] = solid
    start = solid & ~before[:-1]
    if cuts is not None and len(cuts):
        inner = cuts[(cuts > 0) & (cuts < len(solid))]
        start[inner] = solid[inner]
    starts = np.flatnonzero(start)
    if not len(starts):
        return Words(np.empty(0, np.uint64), starts, starts, low)
    lens = np.add.reduceat(solid, starts, dtype=np.int64)
    at = np.arange(len(low)) - np.repeat(starts, np.diff(np.append(starts, len(low)))) if starts[0] == 0 else None
    if at is None:
        at = np.arange(starts[0], len(low)) - np.repeat(starts, np.diff(np.append(starts, len(low))))
        body, ok = low[starts[0] :], solid[starts[0] :]
    else:
        body, ok = low, solid
    np.minimum(at, int(lens.max()), out=at)
    values = _TABLE[body] * _power(int(lens.max()) + 1)[at]
    values[~ok] = 0
    hashes = np.add.reduceat(values, starts - starts[0])
    return Words(mix(hashes + lens.astype(np.uint64)), starts, starts + lens, low)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null reads as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[: offsets[-1]] if column.buffers()[2] is not None and len(column) else np.empty(0, np.uint8)
    return data, offsets


def runs(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, cut at white space."""
    out, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + SLICE_BYTES)
        while hi < len(data) and not _SPACE[data[hi]]:
            hi += 1
        out.append(words(data[lo:hi]).hashes)
        lo = hi
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, bounds): row i of the range has hashes[bounds[i]:bounds[i + 1]]."""
    data, offsets = buffers(column)
    for lo, hi in runs(offsets):
        part = data[offsets[lo] : offsets[hi]]
        if len(part) > 2 * SLICE_BYTES:
            hashes = long_words(part)
            yield lo, hi, hashes, np.array([0, len(hashes)])
            continue
        cuts = offsets[lo : hi + 1] - offsets[lo]
        found = words(part, cuts)
        yield lo, hi, found.hashes, np.searchsorted(found.starts, cuts)
