"""Words of UTF-8 texts between given separator bytes, their places, rows and 64-bit hashes, a slice of bytes at a time.

Separators are ASCII, so bytes and characters give the same words. Whole texts are read: a text
longer than a slice comes in several, cut at separators.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from evigraph.llm import bytescan

#: Bytes of a slice.
SLICE_BYTES = 1 << 20
SPACE = 32
_WINDOW = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(20250301).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)


def table(separators: Iterable[int]) -> np.ndarray:
    """What each byte becomes: A-Z lowered, separators a space."""
    out = np.arange(256, dtype=np.uint8)
    out[list(separators)] = SPACE
    out[65:91] = np.arange(97, 123)
    return out


class Slice(NamedTuple):
    """Bytes begin to end of a column's buffer; row i of the slice, numbered from lo, lies between cuts[i] and cuts[i + 1]."""

    lo: int
    data: np.ndarray
    cuts: np.ndarray


def slices(column: pa.Array, is_break: np.ndarray) -> Iterator[Slice]:
    """The texts of a string column (null reads as empty); longer texts are cut before a byte that is_break marks."""
    data, offsets = bytescan.buffers(column)
    for lo, hi in bytescan.runs(offsets, SLICE_BYTES):
        begin, end = int(offsets[lo]), int(offsets[hi])
        while True:
            stop = end
            if end - begin > 2 * SLICE_BYTES:
                stop = begin + SLICE_BYTES
                while stop < end:
                    found = np.flatnonzero(is_break[data[stop : stop + _WINDOW]])
                    if len(found):
                        stop += int(found[0])
                        break
                    stop = min(end, stop + _WINDOW)
            yield Slice(lo, data[begin:stop], np.clip(offsets[lo : hi + 1] - begin, 0, stop - begin))
            begin = stop
            if begin >= end:
                break


def words(low: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than SPACE; no run crosses a cut."""
    solid = low != SPACE
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(low))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def rows_of(cuts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which row of a slice each place is in."""
    return np.searchsorted(cuts, starts, "right") - 1


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, from one running sum over the slice."""
    global _up, _down
    if len(_up) <= len(low):
        n = max(len(low) + 1, 2 * SLICE_BYTES + 1)
        _up, _down = (np.full(n, np.uint64(x)) for x in (_BASE, _INVERSE))
        _up[0] = _down[0] = 1
        np.multiply.accumulate(_up, out=_up)
        np.multiply.accumulate(_down, out=_down)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_VALUE[low] * _up[: len(low)], out=total[1:])
    return bytescan.mix((total[ends] - total[starts]) * _down[starts] + (ends - starts).astype(np.uint64))
