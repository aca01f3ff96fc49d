"""Set similarity join on word n-grams by signature trees.

A text is the set of its word n-grams, as 64-bit hashes. Equal sets are one. Two sets that reach
the similarity must share one of their first few hashes in any common order, so sets are dealt to
buckets by these prefix hashes; very common hashes come last in the order, which keeps the
buckets small, and a bucket is cut where its sets' sizes leave too wide a gap. In a bucket, sets are the leaves of a tree: each node holds the OR of its
sets' bitmaps and their range of sizes, and two nodes are descended together only while the
greatest overlap that their bitmaps allow can reach what their sizes demand. What is left is
verified on the whole sets. Buckets with the same least set, its leader, are one.

Groups of very many near copies would still give the square of their size in pairs. So each set
is first brought to a few of its leaders, in parts of bounded size, where a tree
finds what links; sets that these links join already are not compared again. Nothing but links
leaves a task that holds whole sets, and no more of them than connect what it found; tasks that
hold bitmaps only name the sets that may link, again by no more pairs than connect them.
No link between two components is lost by this, as every pair of sets from different components
that shares a bucket still goes through that bucket's tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import bytescan
from evigraph.llm.components import components, dealt, segments, spanning
from evigraph.llm.kneser_ney import merge, pack, unpack
from evigraph.llm.shared import Scratch, likely, trim

#: Hashes that come last in the order; so many at most are held by every worker.
COMMON = 100_000
#: A hash that is in the prefix of no more sets than this is not put last.
COMMON_SETS = 100
#: 64-bit words of a bitmap, and of a sketch of parities.
BITMAP = 8
#: Sets of more elements than this have a longer sketch of parities besides, of at least half as many bits as elements.
WIDE_FROM = 800
#: Sets of one bucket, as bitmaps, that meet in one part; and sets that a task takes, of many small buckets or of parts of a large one, or so.
BLOCK, SLOT_ROWS = 1000, 10_000
#: Elements of whole sets of one group that meet in one part, and that a task takes, or so; a set counts as LEAST_SIZE at least.
PART, SLOT, LEAST_SIZE = 500_000, 1_500_000, 1000
#: Leaders to which a set is brought first.
LEADERS = 2
LEAF, FAN = 4, 4
#: Hashes that a task gathers before it packs them, and hashes of one bucket as gathered.
GATHER = 500_000
#: Names of sets that a task remembers, so as not to deal them twice.
MET = 200_000


def overlap_needed(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least intersection of two sets with sizes adding to total whose similarity is percent / 100 or more."""
    return -(-percent * total // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """So many first elements of a set of n: two similar sets share one of theirs."""
    return n - -(-percent * n // 100) + 1


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of one text; the whole text if it has fewer words; empty without words."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    width = min(width, len(hashes))
    out = hashes[: len(hashes) - width + 1]
    for k in range(1, width):
        out = bytescan.chain(out, hashes[k : len(hashes) - width + 1 + k])
    return np.unique(out)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets; the stable sort merges their two runs."""
    z = np.concatenate((x, y))
    z.sort(kind="stable")
    return int(np.count_nonzero(z[1:] == z[:-1]))


def identity(grams: np.ndarray) -> int:
    """A 64-bit name of a set; 0 for the empty set."""
    if not len(grams):
        return 0
    return int(bytescan.mix(np.array([np.add.reduce(bytescan.mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5))) + np.uint64(len(grams))]))[0].view(np.int64)) or 1


def bitmap(grams: np.ndarray) -> np.ndarray:
    """BITMAP words with a bit for each element, by its hash, and BITMAP words with the parity of how many elements share a bit."""
    count = np.bincount(((grams >> np.uint64(20)) % np.uint64(BITMAP * 64)).astype(np.int64), minlength=BITMAP * 64)
    return np.concatenate([np.packbits(b, bitorder="little").view(np.uint64) for b in (count > 0, count % 2 == 1)])


def wide(grams: np.ndarray) -> np.ndarray:
    """Parities in 2 ** k bits, at least half as many as elements; empty for a set of up to WIDE_FROM."""
    if len(grams) <= WIDE_FROM:
        return np.empty(0, np.uint64)
    size = 1 << (len(grams) // 2 - 1).bit_length()
    count = np.bincount(((grams >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(count % 2 == 1, bitorder="little").view(np.uint64)


def sketch(grams: np.ndarray) -> bytes:
    """bitmap() and wide() of a set."""
    return bitmap(grams).tobytes() + wide(grams).tobytes()


def _sketches(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bitmaps, one a row, and longer sketches of a column of sketches."""
    held, base = column.to_pylist(), 16 * BITMAP
    return np.frombuffer(b"".join([x[:base] for x in held]), np.uint64).reshape(len(held), -1), [np.frombuffer(x, np.uint64, offset=base) for x in held]


def _may_link(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int, long_x: list[np.ndarray], long_y: list[np.ndarray]) -> np.ndarray:
    """Whether sketches of sets (rows of x and y, and their longer sketches) allow the similarity.

    Each element of only one set flips one parity, so the parities that differ are at most as many
    as these elements; and the sets share at most as many elements as bits, and the elements that
    share their bit with another.
    """
    need = overlap_needed(n_x + n_y, percent)
    apart = np.bitwise_count(x[:, BITMAP:] ^ y[:, BITMAP:]).sum(axis=1, dtype=np.int64)
    spare = np.minimum(n_x - np.bitwise_count(x[:, :BITMAP]).sum(axis=1, dtype=np.int64), n_y - np.bitwise_count(y[:, :BITMAP]).sum(axis=1, dtype=np.int64))
    most = np.bitwise_count(x[:, :BITMAP] & y[:, :BITMAP]).sum(axis=1, dtype=np.int64) + spare
    ok = (apart <= n_x + n_y - 2 * need) & (most >= need)
    for k in np.flatnonzero(ok & (np.minimum(n_x, n_y) > WIDE_FROM)):
        a, b = long_x[k], long_y[k]
        while len(a) != len(b):  # parities of half as many bits are those of two bits together
            if len(a) > len(b):
                a = a[: len(a) // 2] ^ a[len(a) // 2 :]
            else:
                b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        ok[k] = int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) <= n_x[k] + n_y[k] - 2 * need[k]
    return ok


def _grams(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, hashes, bounds in bytescan.texts(column):
        for a, b in zip(bounds, bounds[1:]):
            yield shingles(hashes[a:b], width)


def _describe(width: int, percent: int):
    """(key, text) to (key, sid, n, bits, pre): pre has a set's first hashes, unless the task has met the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for lo, hi, hashes, bounds in bytescan.texts(batch.column(1)):
                sid, size, bits, pre = [], [], [], []
                for a, b in zip(bounds, bounds[1:]):
                    grams = shingles(hashes[a:b], width)
                    sid.append(identity(grams))
                    size.append(len(grams))
                    bits.append(sketch(grams) if len(grams) else b"")
                    new = len(grams) and _new(sid[-1], met)
                    pre.append(grams[: prefix_size(len(grams), percent)].tobytes() if new else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sid, pa.int64()), pa.array(size, pa.int64()), pa.array(bits, pa.binary()), pa.array(pre, pa.binary())], names=["key", "sid", "n", "bits", "pre"]
                )

    return run


def _new(sid: int, met: set[int]) -> bool:
    """Whether sid is not in met, which then holds it."""
    if sid in met:
        return False
    if len(met) >= MET:
        met.clear()
    met.add(sid)
    return True


def prefix(grams: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The first hashes of a set, common ones last."""
    if not len(grams):
        return grams
    p = prefix_size(len(grams), percent)
    if not len(common):
        return grams[:p]
    last = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
    rare = grams[~last]
    return rare[:p] if len(rare) >= p else np.r_[rare, grams[last][: p - len(rare)]]


def _packed(tokens: list[np.ndarray], others: list[np.ndarray], buckets: int, names: list[str]) -> pa.RecordBatch:
    """One row for each bucket of hashes: hashes and what goes with them, in the hashes' order.

    A set's first hashes are its least ones, so they are mixed again before they are dealt.
    """
    t = np.concatenate(tokens)
    order = np.argsort(t, kind="stable")
    at = (bytescan.mix(t[order]) >> np.uint64(40)).astype(np.int64) * buckets >> 24
    by = np.argsort(at, kind="stable")
    at, order = at[by], order[by]
    t, rest = t[order], [x[order] for x in others]
    cut = np.searchsorted(at, np.arange(buckets + 1))
    full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([pack(x[cut[b] : cut[b + 1]]) for b in full], pa.binary()) for x in (t, *rest))], names=["b", *names])


def _count_prefixes(buckets: int):
    """(pre) to packed prefix hashes by bucket with how often they were met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def part() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            return _packed([t], [n.astype(np.uint32)], buckets, ["t", "o"])

        for batch in batches:
            for pre in batch.column(0).drop_null():
                held.append(np.frombuffer(pre.as_py(), np.uint64))
                size += len(held[-1])
                if size > GATHER:
                    yield part()
                    held, size = [], 0
        if held:
            yield part()
        held.clear()
        trim()

    return run


def _deal_prefixes(width: int, percent: int, common: np.ndarray, buckets: int):
    """(key, text) to packed prefix hashes by bucket, with their sets and these sets' sizes.

    A set that a task meets again is skipped, as are rows without a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        tokens, sids, sizes, size = [], [], [], 0

        def part() -> pa.RecordBatch:
            wide = [len(x) for x in tokens]
            return _packed(tokens, [np.repeat(np.array(sids, np.int64), wide), np.repeat(np.array(sizes, np.uint32), wide)], buckets, ["t", "o", "n"])

        for batch in batches:
            keep = batch.column(0).is_valid().to_pylist()
            for ok, grams in zip(keep, _grams(batch.column(1), width)):
                if not ok or not len(grams) or not _new(sid := identity(grams), met):
                    continue
                tokens.append(prefix(grams, percent, common))
                sids.append(sid)
                sizes.append(len(grams))
                size += len(tokens[-1])
                if size > GATHER:
                    yield part()
                    tokens, sids, sizes, size = [], [], [], 0
        if tokens:
            yield part()
        tokens.clear()
        met.clear()
        trim()

    return run


def _over(limit: int):
    """For applyInArrow on one bucket of counted hashes: those met more than limit times, and how often."""

    def run(table: pa.Table) -> pa.Table:
        tokens, counts = merge([unpack(t, np.uint64) for t in table.column("t").to_pylist()], [unpack(o, np.uint32).astype(np.int64) for o in table.column("o").to_pylist()])
        return pa.table({"token": tokens[counts > limit].view(np.int64), "n": counts[counts > limit]})

    return run


def _chains(tokens: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each row, ordered by token and size, the number of its chain: rows of one token that sizes do not keep apart.

    Of two sets that may be similar, neither those between them in size nor they themselves differ too
    much from the next, so a step in size beyond the similarity ends a chain.
    """
    n = sizes.astype(np.int64)
    return np.cumsum(np.r_[True, (tokens[1:] != tokens[:-1]) | (100 * n[:-1] < percent * n[1:])])


def _shared(percent: int):
    """For applyInArrow on one bucket of hashes and sets: the sets of chains of at least two sets, each once under each of its leaders.

    A chain's leader is the least of its sets.
    """

    def run(table: pa.Table) -> pa.Table:
        tokens, sids, sizes = (np.concatenate([unpack(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("t", np.uint64), ("o", np.int64), ("n", np.uint32)))
        order = np.lexsort((sizes, tokens))
        tokens, sids, sizes = tokens[order], sids[order], sizes[order]
        chain = _chains(tokens, sizes, percent)
        order = np.lexsort((sids, chain))
        chain, sids, sizes = chain[order], sids[order], sizes[order]
        first = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
        c = np.diff(np.append(first, len(chain)))
        lead, n_lead = np.repeat(sids[first], c), np.repeat(sizes[first], c)
        order = np.lexsort((sids, lead))
        lead, n_lead, sids, sizes = lead[order], n_lead[order], sids[order], sizes[order]
        new = np.r_[True, (lead[1:] != lead[:-1]) | (sids[1:] != sids[:-1])]
        new &= sids != lead  # leaders follow their sets
        trim()
        return pa.table({"g": lead[new], "n_g": n_lead[new].astype(np.int64), "sid": sids[new], "n": sizes[new].astype(np.int64)})

    return run


class Tree:
    """A signature tree over the sets of one bucket.

    levels[0] are the sets, each next level holds nodes of FAN children (LEAF at the bottom): OR of
    the bitmaps, smallest and largest size, the most elements that share a bit with another
    element of their set, and the least and greatest component.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, comps: np.ndarray | None = None):
        comps = np.arange(len(sizes)) if comps is None else comps
        #: Sets of one component, like size and like bitmap stand together.
        self.order = np.lexsort((bits[:, 0], bits[:, 1], sizes, comps))
        size, bit, comp = sizes[self.order], bits[self.order, :BITMAP], comps[self.order]
        spare = size - np.bitwise_count(bit).sum(axis=1, dtype=np.int64)
        self.levels = [(bit, size, size, spare, comp, comp)]
        while len(self.levels[-1][1]) > 1:
            bit, low, high, spare, first, last = self.levels[-1]
            cut = np.arange(0, len(low), LEAF if len(self.levels) == 1 else FAN)
            least, most = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((np.bitwise_or.reduceat(bit, cut), least(low, cut), most(high, cut), most(spare, cut), least(first, cut), most(last, cut)))


def dual_traversal(x: Tree, y: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of different components (positions before ordering) that bitmaps and sizes can't rule out; x may be y."""
    same = x is y
    depth = max(len(x.levels), len(y.levels)) - 1
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(depth, -1, -1):
        bx, lx, hx, sx, fx, gx = x.levels[min(level, len(x.levels) - 1)]
        by, ly, hy, sy, fy, gy = y.levels[min(level, len(y.levels) - 1)]
        keep_p, keep_q = [p[:0]], [q[:0]]
        for at in range(0, len(p), 1 << 15):
            a, b = p[at : at + (1 << 15)], q[at : at + (1 << 15)]
            fit = (100 * hx[a] >= percent * ly[b]) & (100 * hy[b] >= percent * lx[a])
            fit &= (fx[a] != gx[a]) | (fy[b] != gy[b]) | (fx[a] != fy[b])
            a, b = a[fit], b[fit]
            most = np.bitwise_count(bx[a] & by[b]).sum(axis=1, dtype=np.int64) + np.minimum(sx[a], sy[b])
            most = np.minimum(most, np.minimum(hx[a], hy[b]))
            ok = most >= overlap_needed(lx[a] + ly[b], percent)
            keep_p.append(a[ok])
            keep_q.append(b[ok])
        p, q = np.concatenate(keep_p), np.concatenate(keep_q)
        if level:
            p, q = _children(p, q, level, x, y, same)
    if same:
        p, q = p[p < q], q[p < q]
    return x.order[p], y.order[q]


def _children(p: np.ndarray, q: np.ndarray, level: int, x: Tree, y: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    def below(nodes, tree):
        if level > len(tree.levels) - 1:  # the tree is lower: stay at its root
            return nodes[:, None], np.ones((len(nodes), 1), bool)
        fan = LEAF if level == 1 else FAN
        child = nodes[:, None] * fan + np.arange(fan)
        return child, child < len(tree.levels[level - 1][1])

    cx, ox = below(p, x)
    cy, oy = below(q, y)
    a = np.repeat(cx, cy.shape[1], axis=1)
    b = np.tile(cy, (1, cx.shape[1]))
    ok = np.repeat(ox, cy.shape[1], axis=1) & np.tile(oy, (1, cx.shape[1]))
    if same:
        ok &= a <= b
    return a[ok], b[ok]


def _pairs(rows: np.ndarray, blocks: np.ndarray, i: int, j: int, sizes: np.ndarray, bits: np.ndarray, long: list[np.ndarray], comps: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components, one of block i and one of block j, whose sketches allow the similarity; found by trees."""
    left, right = (rows, rows) if i == j else (rows[blocks[rows] == i], rows[blocks[rows] == j])
    if not len(left) or not len(right) or len(rows) < 2:
        return left[:0], left[:0]
    x = Tree(sizes[left], bits[left], comps[left])
    p, q = dual_traversal(x, x if i == j else Tree(sizes[right], bits[right], comps[right]), percent)
    p, q = left[p], right[q]
    out = []
    for at in range(0, len(p), 1 << 16):
        a, b = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
        ok = comps[a] != comps[b]
        x, y = a[ok], b[ok]
        ok[ok] = _may_link(bits[x], bits[y], sizes[x], sizes[y], percent, [long[k] for k in x], [long[k] for k in y])
        out.append((a[ok], b[ok]))
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (p, q)


def _candidates(percent: int):
    """For applyInArrow on one slot of buckets: pairs that connect all sets of different components which sketches let be similar."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, names = np.unique(table.column("sid").to_numpy(), return_inverse=True)
        comps, blocks, sizes, left, right = (table.column(c).to_numpy() for c in ("comp", "_b", "n", "_i", "_j"))
        bits, long = _sketches(table.column("bits"))
        one, two, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for rows in segments(table, ["g", "_i", "_j"]):
            p, q = _pairs(rows, blocks, left[rows[0]], right[rows[0]], sizes, bits, long, comps, percent)
            one.append(names[p])
            two.append(names[q])
            held += len(p)
            if held > 1_000_000:  # what connects the pairs so far is enough
                a, b = np.concatenate(one), np.concatenate(two)
                keep = spanning(a, b, len(ids))
                one, two, held = [a[keep]], [b[keep]], 0
        a, b = np.concatenate(one), np.concatenate(two)
        keep = spanning(a, b, len(ids))
        trim()
        return pa.table({"a": ids[a[keep]], "b": ids[b[keep]]})

    return run


def _links(width: int, percent: int):
    """For applyInArrow on one slot of groups, with texts: links that connect all that is similar in each group's part.

    Candidates of a part come from trees. In turns, pairs that connect all candidates not yet
    joined are compared on the whole sets, until each is a link, is refuted or is joined by links.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, first, names = np.unique(table.column("sid").to_numpy(), return_index=True, return_inverse=True)
        text, comp = table.column("text"), table.column("comp").to_numpy()
        _, label = np.unique(comp[first], return_inverse=True)
        grams: list[np.ndarray] = [np.empty(0, np.uint64)] * len(ids)
        found = np.zeros(len(ids), bool)
        for row, name in enumerate(names):  # a key may have several texts
            if not found[name]:
                made = shingles(bytescan.long_words(np.frombuffer(text[row].as_py().encode(), np.uint8)), width)
                if identity(made) == ids[name]:
                    grams[name], found[name] = made, True
        sizes, bits, long = np.array([len(x) for x in grams], np.int64), np.stack([bitmap(x) for x in grams]), [wide(x) for x in grams]
        blocks, left, right = (table.column(c).to_numpy() for c in ("_b", "_i", "_j"))
        one, two = [], []
        for rows in segments(table, ["g", "_i", "_j"]):
            rows = rows[found[names[rows]]]
            rows = rows[np.unique(names[rows], return_index=True)[1]]
            if len(rows) < 2:
                continue
            at = names[rows]
            p, q = _pairs(np.arange(len(rows)), blocks[rows], left[rows[0]], right[rows[0]], sizes[at], bits[at], [long[k] for k in at], label[at], percent)
            p, q = at[p], at[q]
            while len(p):
                x, y = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
                turn = spanning(x, y, int(y.max()) + 1)
                good = np.array([_similar(grams[a], grams[b], percent) for a, b in zip(p[turn], q[turn])], bool)
                hits = turn[good]
                if len(hits):
                    one.append(ids[p[hits]])
                    two.append(ids[q[hits]])
                    label = _joined(label, x[hits], y[hits])
                rest = np.ones(len(p), bool)
                rest[turn] = False
                rest &= label[p] != label[q]
                p, q = p[rest], q[rest]
        del grams
        trim()
        none = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate(one or none), "b": np.concatenate(two or none)})

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = overlap(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _joined(label: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Labels after the classes low and high, which stand on a forest, become one each."""
    top = np.arange(int(label.max()) + 1)
    while (apart := low != high).any():
        low, high = low[apart], high[apart]
        top[high] = np.minimum(top[high], low)  # one of the edges of a class; the others follow
        while (top[top] != top).any():
            top = top[top]
        low, high = top[low], top[high]
        low, high = np.minimum(low, high), np.maximum(low, high)
    return top[label]


def _confirmed(placed: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among sets that placed (sid, comp, g, _b, _i, _j, _slot) brings together, compared on the whole texts, read again from one text of each set."""
    wanted = sets.select("sid", "key").join(placed, "sid")
    texts = likely(docs.select("key", "text"), "key", wanted.select("key")).join(wanted, "key")
    return texts.select("_slot", "g", "_b", "_i", "_j", "sid", "comp", "text").groupBy("_slot").applyInArrow(_links(width, percent), "a long, b long")


def _slots(rows: DataFrame, weight: str, size: int) -> int:
    """So many slots take rows of the given weights, about size each."""
    return max(8, -(-(rows.agg(F.sum(weight)).first()[0] or 0) // size))


def similar_texts(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Components of texts whose sets of word n-grams have a Jaccard similarity of percent / 100 or more.

    One row per row of docs: key (bigint), n_shingles (size of the set), component_id (smallest
    key reachable by links, itself included). Words are runs without white space, A-Z lower-cased.
    Texts of fewer than ``width`` words are one n-gram; null, empty and blank texts have an empty set
    and link with nothing. Repeated rows and rows with one key and several texts keep a row each;
    a row with a null key links with nothing and has a null component. An empty table gives no
    rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    seen = scratch.save(rows.mapInArrow(_describe(width, percent), "key long, sid long, n long, bits binary, pre binary"), "seen")
    good = "key is not null and n > 0"
    sets = scratch.save(seen.filter(good).groupBy("sid").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits")), "sets")
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    total = seen.filter(good).agg(F.sum(size)).first()[0] or 0
    buckets = max(4, -(-total // GATHER))
    often = seen.select("pre").mapInArrow(_count_prefixes(buckets), "b int, t binary, o binary").groupBy("b").applyInArrow(_over(COMMON_SETS), "token long, n long")
    common = often.orderBy(F.desc("n"), "token").limit(COMMON).select("token").toArrow().column("token").to_numpy()
    common = np.sort(common.astype(np.int64).view(np.uint64))

    # groups: a leader and all sets that share one of its buckets and are near in size, by steps
    spread = rows.mapInArrow(_deal_prefixes(width, percent, common, buckets), "b int, t binary, o binary, n binary").groupBy("b")
    members = scratch.save(spread.applyInArrow(_shared(percent), "g long, n_g long, sid long, n long").distinct(), "members")

    # a set first meets the least of its leaders
    near = F.least("n", "n_g") * 100 >= percent * F.greatest("n", "n_g")
    ranked = members.filter(near).groupBy("sid").agg(F.slice(F.array_sort(F.collect_set("g")), 1, LEADERS).alias("leads")).select("sid", F.explode("leads").alias("g"))
    bits = sets.select("sid", "n", "bits")
    stars = scratch.save(
        ranked.join(bits.select("sid", F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "sid")
        .join(bits.select(F.col("sid").alias("g"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "g")
        .mapInArrow(_possible(percent), "sid long, g long, w long"),
        "stars",
    )
    many = stars.groupBy("g").agg(F.sum("w").alias("c")).select("g", F.ceil(F.col("c") / F.lit(PART)).cast("int").alias("parts"))
    led = stars.join(many, "g").select("sid", "g", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("_i"))
    heads = many.select(F.col("g").alias("sid"), "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_i"))
    slots = _slots(stars, "w", SLOT)
    slot = F.pmod(F.xxhash64("g", "_i"), F.lit(slots)).cast("int").alias("_slot")
    placed = led.unionByName(heads).select("sid", F.col("sid").alias("comp"), "g", F.col("_i").alias("_b"), "_i", F.col("_i").alias("_j"), slot)
    links = scratch.save(_confirmed(scratch.save(placed, "led"), rows, sets, width, percent), "links1")
    joined = scratch.save(components(links, "a", "b", scratch, "near"), "joined")

    # the trees, for groups with more than one component
    every = members.select("sid", "n", "g").unionByName(members.select(F.col("g").alias("sid"), F.col("n_g").alias("n"), "g").distinct())
    named = every.join(joined.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "n", "g", F.coalesce("component", "sid").alias("comp"), F.lit(1).alias("w"))
    full = dealt(named, "g", "comp", "sid", "w", BLOCK, _slots(named, "w", SLOT_ROWS)).join(sets.select("sid", "bits"), "sid")
    pairs = scratch.save(full.groupBy("_slot").applyInArrow(_candidates(percent), "a long, b long").distinct(), "pairs")
    grouped = scratch.save(components(pairs, "a", "b", scratch, "groups"), "grouped").select(F.col("id").alias("sid"), F.col("component").alias("g"))
    open_ = grouped.join(joined.withColumnRenamed("id", "sid"), "sid", "left").join(sets.select("sid", "n"), "sid")
    open_ = open_.select("sid", "g", F.coalesce("component", "sid").alias("comp"), F.greatest("n", F.lit(LEAST_SIZE)).alias("w"))
    placed = scratch.save(dealt(open_, "g", "comp", "sid", "w", PART, _slots(open_, "w", SLOT)), "open")
    rest = scratch.save(_confirmed(placed, rows, sets, width, percent), "links2")
    scratch.drop("members", "pairs", "grouped", "stars", "led", "open")

    # from sets to texts: the smallest key of a component's sets
    of = joined.select("id", "component")
    ends = rest.join(of.select(F.col("id").alias("a"), F.col("component").alias("p")), "a", "left").join(of.select(F.col("id").alias("b"), F.col("component").alias("q")), "b", "left")
    over = components(ends.select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")), "a", "b", scratch, "all")
    over = over.select(F.col("id").alias("first"), F.col("component").alias("whole"))
    placed = sets.select("sid", "key").join(of.withColumnRenamed("id", "sid"), "sid", "left").withColumn("first", F.coalesce("component", "sid"))
    placed = placed.join(over, "first", "left").select("sid", "key", F.coalesce("whole", "first").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("key").alias("component_id"))
    of_set = scratch.save(placed.join(smallest, "component").select("sid", "component_id"), "of_set")
    linked = seen.filter(good).select("key", "n", "sid").join(of_set, "sid")
    alone = seen.filter(f"not ({good})").withColumn("component_id", F.col("key"))
    cols = [F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id"]
    return linked.select(cols).unionByName(alone.select(cols))


def _possible(percent: int):
    """(sid, g, n_a, bits_a, n_b, bits_b) to the pairs that bitmaps can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            col = lambda c: batch.column(names.index(c))
            n_a, n_b = col("n_a").to_numpy(), col("n_b").to_numpy()
            (x, long_x), (y, long_y) = (_sketches(col(c)) for c in ("bits_a", "bits_b"))
            ok = pa.array(_may_link(x, y, n_a, n_b, percent, long_x, long_y))
            yield pa.RecordBatch.from_arrays([col("sid").filter(ok), col("g").filter(ok), pa.array(np.maximum(n_a, LEAST_SIZE)).filter(ok)], names=["sid", "g", "w"])

    return run
