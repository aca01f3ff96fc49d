"""Static range asymmetric numeral systems over token ids, many interleaved states at a time.

A block is a matrix of steps x LANES ids; lane k codes every LANES-th id with a state of its own.
States lie in [2**24, 2**48) and give away words of 24 bits. Blocks are independent of each other,
so they are encoded beside each other. A block keeps checkpoints: the states, and the place in its
words, every SEGMENT_STEPS steps. From each of them decoding can begin, so all segments of all
blocks are decoded beside each other.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

LANES = 64
SEGMENT_STEPS = 512
SEGMENTS = 8
BLOCK_IDS = LANES * SEGMENT_STEPS * SEGMENTS
#: Bits of the frequencies' total.
BITS = 20
_LOW, _WORD = 24, 24
#: Steps whose frequencies are looked up at once.
_CHUNK = 64
_TOP = 48


class Table(NamedTuple):
    """Shares of 2**BITS for each id: freq, where its share begins, and whose share each place is."""

    freq: np.ndarray
    start: np.ndarray
    owner: np.ndarray


class Block(NamedTuple):
    n_ids: int
    words: np.ndarray  # uint32, 24 bits each
    states: np.ndarray  # one row of LANES states for each segment
    places: np.ndarray  # where each segment's words begin


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS; every id with a count gets at least 1."""
    total, whole = int(counts.sum()), 1 << BITS
    used = counts > 0
    if int(used.sum()) > whole:
        raise ValueError("more different ids than places")
    freq = np.where(used, np.maximum(1, counts.astype(np.float64) * whole / max(1, total)).astype(np.int64), 0)
    over = int(freq.sum()) - whole
    if total and over < 0:
        freq[int(np.argmax(freq))] -= over
    while total and over > 0:
        spare = freq - used
        take = np.minimum(spare, spare * over // int(spare.sum()))
        if not take.any():
            take[np.argsort(-spare, kind="stable")[: min(over, int((spare > 0).sum()))]] = 1
        freq -= take
        over -= int(take.sum())
    return freq


def table(freq: np.ndarray) -> Table:
    start = np.cumsum(freq) - freq
    return Table(freq.astype(np.int64), start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


def encode(ids: np.ndarray, of: Table) -> list[Block]:
    """Blocks of BLOCK_IDS ids; the last one may be shorter."""
    out, whole = [], len(ids) // BLOCK_IDS
    if whole:
        out += _encode(ids[: whole * BLOCK_IDS].reshape(whole, -1, LANES), of, BLOCK_IDS)
    rest = ids[whole * BLOCK_IDS :]
    if len(rest):
        # filled up with the most frequent id; n_ids tells what counts
        fill = np.full(-len(rest) % LANES, int(np.argmax(of.freq)), ids.dtype)
        out += _encode(np.concatenate([rest, fill]).reshape(1, -1, LANES), of, len(rest))
    return out


def _encode(ids: np.ndarray, of: Table, n_ids: int) -> list[Block]:
    blocks, steps, _ = ids.shape
    x = np.full(blocks * LANES, 1 << _LOW, np.int64)
    words, lanes, sizes = [], [], np.zeros(steps, np.int64)
    points = -(-steps // SEGMENT_STEPS)
    states = np.empty((points, blocks, LANES), np.int64)
    ratio = np.empty(len(x))
    for begin in range((steps - 1) // _CHUNK * _CHUNK, -1, -_CHUNK):
        end = min(steps, begin + _CHUNK)
        s = ids[:, begin:end].transpose(1, 0, 2).reshape(end - begin, -1).astype(np.intp)
        freq, start = of.freq.take(s), of.start.take(s)
        limit, rest, divisor = freq << (_TOP - BITS), (1 << BITS) - freq, freq.astype(np.float64)
        for t in range(end - begin - 1, -1, -1):
            full = np.flatnonzero(x >= limit[t])
            high = x[full]
            words.append(high)
            lanes.append(full)
            sizes[begin + t] = len(full)
            x[full] = high >> _WORD
            # exact: x is below 2**48 and the divisor at most 2**20, so a quotient is never rounded up to a whole number
            np.divide(x, divisor[t], out=ratio)
            x += ratio.astype(np.int64) * rest[t]
            x += start[t]
            if (begin + t) % SEGMENT_STEPS == 0:
                states[(begin + t) // SEGMENT_STEPS] = x.reshape(blocks, LANES)
    word = (np.concatenate(words[::-1]) & ((1 << _WORD) - 1)).astype(np.uint32)
    owner = np.concatenate(lanes[::-1]) // LANES
    by_block = word[np.argsort(owner, kind="stable")]
    told = np.bincount(np.repeat(np.arange(steps), sizes) * blocks + owner, minlength=steps * blocks).reshape(steps, blocks)
    before, ends = np.cumsum(told, axis=0), np.cumsum(told.sum(axis=0))
    out = []
    for b in range(blocks):
        places = np.array([0, *(int(before[k * SEGMENT_STEPS - 1, b]) for k in range(1, points))], np.int64)
        out.append(Block(n_ids, by_block[ends[b] - told[:, b].sum() : ends[b]], states[:, b], places))
    return out


def decode(blocks: list[Block], of: Table) -> np.ndarray:
    """The ids of blocks, one after the other; an end state that isn't the first state of encoding is an error."""
    if not blocks:
        return np.empty(0, np.uint32)
    base = np.cumsum([0, *(len(b.words) for b in blocks)])
    words = np.concatenate([b.words for b in blocks]).astype(np.int64) if base[-1] else np.zeros(1, np.int64)
    at = np.cumsum([0, *(-(-b.n_ids // LANES) * LANES for b in blocks)])
    out = np.empty(int(at[-1]), np.uint32)
    units: dict[int, list[tuple[int, int, int]]] = {}  # steps -> (block, segment, first id)
    for i, b in enumerate(blocks):
        steps = -(-b.n_ids // LANES)
        for k in range(len(b.states)):
            n = min(SEGMENT_STEPS, steps - k * SEGMENT_STEPS)
            units.setdefault(n, []).append((i, k, int(at[i]) + k * SEGMENT_STEPS * LANES))
    for steps, found in units.items():
        x = np.stack([blocks[i].states[k] for i, k, _ in found]).reshape(-1)
        place = np.array([base[i] + blocks[i].places[k] for i, k, _ in found])
        ids = np.empty((steps, len(x)), np.uint32)
        for t in range(steps):
            slot = x & ((1 << BITS) - 1)
            s = of.owner.take(slot)
            ids[t] = s
            x >>= BITS
            x *= of.freq.take(s)
            x += slot
            x -= of.start.take(s)
            low = np.flatnonzero(x < 1 << _LOW)
            if len(low):
                unit = low // LANES
                taken = np.bincount(unit, minlength=len(place))
                place += taken
                where = (place - np.cumsum(taken)).take(unit) + np.arange(len(low))
                if int(where.max()) >= len(words):
                    raise ValueError("a block ends too early")
                x[low] = x[low] << _WORD | words.take(where)
        ids, x = ids.reshape(steps, -1, LANES).transpose(1, 0, 2), x.reshape(-1, LANES)
        for (i, k, first), part, end in zip(found, ids, x):
            out[first : first + steps * LANES] = part.reshape(-1)
            last = k == len(blocks[i].states) - 1
            if not (end == (1 << _LOW) if last else end == blocks[i].states[k + 1]).all():
                raise ValueError("a block does not decode to the state it began with")
    if all(b.n_ids % LANES == 0 for b in blocks):
        return out
    return np.concatenate([out[a : a + b.n_ids] for a, b in zip(at, blocks)])
