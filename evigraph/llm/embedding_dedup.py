"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and quantised; a few quantised
projections together name a bucket of one table. Vectors at a cosine of 0.98 lie within 0.2 of
each other and share a bucket of some table with a probability of over 0.999 at the default
parameters; every pair that shares one is compared exactly, in the first table it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from evigraph.llm.components import blocked, components, segments
from evigraph.llm.shared import Scratch

TABLES, PROJECTIONS, WIDTH, SEED = 40, 12, 1.2, 7
#: Vectors of one bucket that one task compares.
BLOCK = 1500


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, vectors in double precision, lengths by row) of the usable rows of a list column."""
    rows, flat = [], []
    for i, v in enumerate(column):
        x = None if not v.is_valid else np.array([np.nan if y is None else y for y in v.as_py()], np.float64)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            rows.append(i)
            flat.append(x)
    return rows, flat


def hash_keys(x: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Bucket keys (n x tables, int64) of unit vectors (n x d)."""
    rng = np.random.default_rng([seed, x.shape[1]])
    lines = rng.standard_normal((x.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    cells = np.floor((x @ lines + shift) / width).astype(np.int64).reshape(len(x), tables, projections)
    key = np.zeros((len(x), tables), np.int64)
    with np.errstate(over="ignore"):
        for p in range(projections):
            key = (key ^ (key >> 29)) * np.int64(0x5851F42D4C957F2D) + cells[:, :, p] * np.int64(0x14057B7EF767814F) + p
    return key


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) to (id, label, unit vector in bytes, keys), usable rows only."""
    for batch in batches:
        rows, flat = _matrix(batch.column(2))
        for size in sorted({len(v) for v in flat}):
            take = [i for i, v in enumerate(flat) if len(v) == size]
            x = np.stack([flat[i] for i in take])
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            at = pa.array([rows[i] for i in take], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(list(hash_keys(x)), pa.list_(pa.int64()))],
                names=["vec", "label", "unit", "keys"],
            )


#: What tells a bucket's pair of blocks from others in a slot.
BUCKET = ["label", "size", "t", "key"]
#: Rows that a slot takes, or so.
SLOT_ROWS = 20_000


def _compare(threshold: float):
    """For applyInArrow on one slot: for every pair of blocks partial degrees and a spanning forest of its links."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, weights, blocks, tables, left_of, right_of = (table.column(c).to_numpy() for c in ("vec", "weight", "_b", "t", "_i", "_j"))
        units, all_keys = table.column("unit").chunk(0), table.column("keys").chunk(0)
        kind, one, two = [], [], []
        for rows in segments(table, [*BUCKET, "_i", "_j"]):
            if len(rows) < 2:
                continue
            t, i, j = int(tables[rows[0]]), left_of[rows[0]], right_of[rows[0]]
            x = np.frombuffer(b"".join([units[int(r)].as_py() for r in rows]), np.float64).reshape(len(rows), -1)
            at = pa.array(rows)
            keys = all_keys.take(at).flatten().to_numpy().reshape(len(rows), -1)[:, :t]
            left, right = np.flatnonzero(blocks[rows] == i), np.flatnonzero(blocks[rows] == j)
            weight, degree = weights[rows], np.zeros(len(rows), np.int64)
            near = np.zeros((len(left), len(right)), bool)
            for lo in range(0, len(left), 256):
                part = x[left[lo : lo + 256]] @ x[right].T >= threshold
                if i == j:
                    part &= left[lo : lo + 256, None] < right[None, :]
                p, q = np.nonzero(part)
                if t and len(p):
                    first = ~(keys[left[lo + p]] == keys[right[q]]).any(axis=1)
                    p, q = p[first], q[first]
                np.add.at(degree, left[lo + p], weight[right[q]])
                np.add.at(degree, right[q], weight[left[lo + p]])
                near[lo + p, q] = True
            touched = np.flatnonzero(degree)
            if len(touched):
                a, b = _forest(near, left, right, i == j)
                kind.append(np.r_[np.zeros(len(touched), np.int32), np.ones(len(a), np.int32)])
                one.append(np.r_[ids[rows[touched]], ids[rows[a]]])
                two.append(np.r_[degree[touched], ids[rows[b]]])
        join = lambda parts, of: pa.array(np.concatenate(parts).astype(of) if parts else np.empty(0, of))
        return pa.table({"kind": join(kind, np.int32), "a": join(one, np.int64), "b": join(two, np.int64)})

    return run


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the matrix of links connects, at most one less than there are nodes."""
    out_a, out_b = [], []
    if same:
        near = near | near.T
    open_left, open_right = near.any(axis=1), near.any(axis=0)
    while open_left.any():
        root = int(np.argmax(open_left))
        open_left[root] = False
        if same:
            open_right[root] = False
        front = [root]
        while front:
            new = near[front].any(axis=0) & open_right
            cols = np.flatnonzero(new)
            if not len(cols):
                break
            from_ = np.array(front)[near[np.ix_(front, cols)].argmax(axis=0)]
            out_a.append(left[from_])
            out_b.append(right[cols])
            open_right[cols] = False
            if same:
                open_left[cols] = False
                front = list(cols)
                continue
            rows = np.flatnonzero(near[:, cols].any(axis=1) & open_left)
            if len(rows):
                to = cols[near[np.ix_(rows, cols)].argmax(axis=1)]
                out_a.append(left[rows])
                out_b.append(right[to])
                open_left[rows] = False
            front = list(rows)
    none = np.empty(0, np.int64)
    return (np.concatenate(out_a) if out_a else none), (np.concatenate(out_b) if out_b else none)


def near_vectors(vectors: DataFrame, key: str, vector: str, label: str, threshold: float = 0.98) -> DataFrame:
    """Links between vectors of one label with a cosine of at least threshold.

    One row per row of vectors: vec_id, n_links (other rows linked directly), component_id
    (smallest key reachable by links, itself included), kept (vec_id = component_id). Vectors that
    are null, empty, zero or hold null or non-finite components, and rows with a null label or a
    null key, link with nothing; vectors of different lengths do not link. Equal vectors are
    compared once and counted as often as they occur (repeated rows too). Keys are to be unique:
    different vectors of one key count as one node, whose links add up. An empty table gives no
    rows. Only the three named columns are read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    name = F.col(label)
    if not isinstance(vectors.schema[label].dataType, IntegralType):
        name = F.when(name.isNotNull(), F.xxhash64(name.cast("string")))  # labels are only compared
    source = vectors.select(F.col(key).cast("long").alias("vec"), name.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = source.filter("label is not null and vec is not null")
    keyed = scratch.save(usable.mapInArrow(_keyed, "vec long, label long, unit binary, keys array<long>"), "keyed")
    same = scratch.save(keyed.groupBy("label", "unit").agg(F.min("vec").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("keys").alias("keys")), "same")
    long = same.select(F.col("rep").alias("vec"), "label", F.octet_length("unit").alias("size"), F.posexplode("keys").alias("t", "key"))
    crowd = scratch.save(long.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowd")
    slots = max(8, -(-(crowd.agg(F.sum("n")).first()[0] or 0) // SLOT_ROWS))
    met = long.join(crowd, BUCKET)
    full = met.join(same.select(F.col("rep").alias("vec"), "label", "weight", "unit", "keys"), ["vec", "label"])
    dealt = blocked(full, BUCKET, "n", "vec", BLOCK, slots)
    found = scratch.save(dealt.groupBy("_slot").applyInArrow(_compare(threshold), "kind int, a long, b long"), "found")
    links = found.filter("kind = 1").select("a", "b")
    degree = found.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("degree")).withColumnRenamed("a", "rep")
    # a node is the least key of equal vectors, so different vectors under one key are one node
    joined = components(links, "a", "b", scratch).withColumnRenamed("id", "rep")
    by_rep = same.select("label", "unit", "rep", "weight").join(degree, "rep", "left").join(joined, "rep", "left")
    solved = keyed.select("vec", "label", "unit").join(by_rep, ["label", "unit"])
    linked = solved.select(
        F.col("vec").alias("vec_id"),
        (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    # rows that could not be compared: as many of each key as the usable table lacks
    have = keyed.groupBy("vec").agg(F.count(F.lit(1)).alias("have"))
    total = source.groupBy("vec").agg(F.count(F.lit(1)).alias("total"))
    rest = total.join(have, "vec", "left").withColumn("missing", F.col("total") - F.coalesce("have", F.lit(0))).filter("missing > 0")
    alone = rest.select(F.col("vec").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"), F.explode(F.sequence(F.lit(1), F.col("missing").cast("int"))).alias("_k")).drop("_k")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
