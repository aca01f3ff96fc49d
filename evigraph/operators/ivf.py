"""Nearest neighbours by an inverted file: vectors in cells around centres, searched cell by cell.

The index is a table of all vectors, clustered by cell, so that a search reads the cells it probes.
Centres are fitted on a bounded sample; every vector is indexed. A search of some cells is near, one
that goes on to every cell that can still hold a nearer vector is exact: a vector lies within its
cell's radius of the centre, so none in a cell is nearer than the centre's distance less the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import retrieval as R

#: Rows that centres are fitted on, at most: those of the smallest hashes of their ids. Cells, at most.
FIT_ROWS, MOST_CELLS = 100_000, 4096
#: Vectors of a cell that one task compares; a larger cell is cut into parts.
PART_ROWS = 4000
ITERATIONS, PROBES = 12, 8
#: Queries that the number of probes is measured on, at most, and the share of neighbours that they should find.
TUNE_ROWS, TARGET = 500, 0.95
_SLACK = 1e-6  # what rounding may take from a bound


@dataclass
class Index:
    """cells: cell, id, v. Centres, radii and sizes have one entry a cell, at most MOST_CELLS."""

    cells: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    metric: str


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors that a search takes: with an id, and numbers that are finite (as in retrieval.knn)."""
    return vectors.filter("id is not null and v is not null and forall(v, x -> x is not null and abs(x) < double('infinity'))").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))


def _rows(column: pa.ListArray, dim: int, metric: str) -> np.ndarray:
    """Vectors as rows of one length, shorter ones filled with zeros; of unit length for cosines."""
    x = R._matrix(column)
    x = np.pad(x, ((0, 0), (0, max(0, dim - x.shape[1]))))
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n == 0, 1, n)
    return x


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows from all centres."""
    wide = max(x.shape[1], centres.shape[1])
    x, centres = (np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in (x, centres))
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0))


def kmeans(x: np.ndarray, cells: int, seed: int = 0, iterations: int = ITERATIONS) -> np.ndarray:
    """Centres of at most ``cells`` cells: Lloyd's steps from distinct rows; an empty cell moves to the row that is farthest off."""
    rng = np.random.default_rng(seed)
    start = np.unique(x, axis=0)
    centres = start[rng.permutation(len(start))[:cells]]
    for _ in range(iterations):
        nearest, gap = np.empty(len(x), np.int64), np.empty(len(x))
        for lo in range(0, len(x), 4096):
            d = _gaps(x[lo : lo + 4096], centres)
            nearest[lo : lo + 4096], gap[lo : lo + 4096] = d.argmin(1), d.min(1)
        size = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        moved = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        far = np.argsort(-gap, kind="stable")
        for at, cell in zip(far, np.flatnonzero(size == 0)):
            moved[cell] = x[at]
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def build(vectors: DataFrame, path: str, cells: int | None = None, metric: str = "l2sq", seed: int = 0) -> Index:
    """Index every usable vector (id, v) as a table at path.

    cells: the square root of the number of vectors by default, MOST_CELLS at most; there are never
    more cells than different vectors in the sample. metric: l2sq or cosine.
    """
    spark, usable = vectors.sparkSession, _usable(vectors)
    about = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    wanted = min(MOST_CELLS, cells or max(1, int(about["n"] ** 0.5)))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow()
    centres = kmeans(_rows(sample.column("v").combine_chunks(), about["dim"], metric), wanted, seed) if about["n"] else np.zeros((0, 1))
    dim = about["dim"] or 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                d = _gaps(_rows(part.column(1), dim, metric), centres)
                yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1)), part.column(0), part.column(1)], names=["cell", "gap", "id", "v"])

    placed = usable.mapInArrow(assign, "cell int, gap double, id long, v array<double>") if len(centres) else spark.createDataFrame([], "cell int, gap double, id long, v array<double>")
    placed.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.mode("overwrite").parquet(path)
    table = spark.read.schema("cell int, gap double, id long, v array<double>").parquet(path)
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in table.groupBy("cell").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        radius[r["cell"]], sizes[r["cell"]] = r["gap"], r["n"]
    return Index(table.select("cell", "id", "v"), centres, radius, sizes, metric)


def _cells_for(index: Index, probes: int, within: bool):
    """(id, v, reach) to (cell, id, v): the nearest ``probes`` cells, or all others that may hold a vector within reach."""
    centres, radius, full, metric = index.centres, index.radius, index.sizes > 0, index.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                d = _gaps(_rows(part.column(1), centres.shape[1], metric), centres)
                d[:, ~full] = np.inf
                order = np.argsort(d, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(d.shape[1])[None], axis=1)
                if within:
                    least = np.maximum(d - radius[None] - _SLACK, 0) ** 2 / (2 if metric == "cosine" else 1)
                    row, cell = np.nonzero((place >= probes) & np.isfinite(d) & (least <= part.column(2).to_numpy(zero_copy_only=False)[:, None] + _SLACK))
                else:
                    row, cell = np.nonzero((place < probes) & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["cell", "id", "v"])

    return run


def _meet(index: Index, pairs: DataFrame, blocks: int, k: int) -> DataFrame:
    """query_id, id, distance: the best k of each query in each part of each cell it is paired with."""
    spark = pairs.sparkSession
    cut = spark.createDataFrame([(c, -(-int(n) // PART_ROWS)) for c, n in enumerate(index.sizes) if n], "cell int, parts int")  # a row a cell
    block: Column = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = pairs.join(F.broadcast(cut), "cell").select(F.lit(True).alias("q"), "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"), "id", "v")
    met = pairs.select("cell", block.alias("block")).distinct()
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    held = index.cells.join(F.broadcast(cut), "cell").withColumn("part", part).join(met, "cell").select(F.lit(False).alias("q"), "cell", "part", "block", "id", "v")
    top = R._top(k, index.metric)
    return asked.unionByName(held).groupBy("cell", "part", "block").applyInArrow(lambda t: top(t.select(["q", "id", "v"])), "query_id long, id long, distance double")


def search(queries: DataFrame, index: Index, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """query_id, id, distance, score, rank, as retrieval.knn gives them, from the nearest ``probes`` cells of each query (id, v).

    With exact, a second round goes through all other cells that may hold one of the k nearest, so
    the rows are those of the whole scan. Without it a query finds fewer than k where its cells hold
    fewer. Queries that knn leaves out find nothing here either.
    """
    if not len(index.centres):
        return R.knn(queries, index.cells.select("id", "v"), k, index.metric)
    asked = _usable(queries)
    blocks = max(1, -(-asked.count() // R.BLOCK))
    reach = F.lit(float("inf"))
    near = asked.withColumn("reach", reach).mapInArrow(_cells_for(index, probes, False), "cell int, id long, v array<double>")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = best(_meet(index, near, blocks, k)).drop("rank")
    if exact:
        least = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("reach"))
        rest = asked.join(least, "id", "left").select("id", "v", F.coalesce("reach", reach).alias("reach")).mapInArrow(_cells_for(index, probes, True), "cell int, id long, v array<double>")
        found = found.unionByName(_meet(index, rest, blocks, k))
    return best(found).withColumn("score", T.clip(1 - F.col("distance")))


def tune(queries: DataFrame, index: Index, k: int, target: float = TARGET) -> int:
    """How many cells a search should probe so that, of the k nearest of queries like these, the share ``target`` is found.

    Measured on at most TUNE_ROWS of the queries (those of the smallest hashes of their ids): their
    exact neighbours are found, and the place of each one's cell among the query's nearest is counted.
    """
    sample = _usable(queries).orderBy(F.xxhash64("id"), "id").limit(TUNE_ROWS)
    centres, full, metric = index.centres, index.sizes > 0, index.metric

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _gaps(_rows(batch.column(0), centres.shape[1], metric), centres)
            d[:, ~full] = np.inf
            own = d[np.arange(len(d)), batch.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array((d < own[:, None]).sum(1) + 1)], names=["place"])

    found = search(sample, index, k, exact=True).select("query_id", "id").join(index.cells.select("id", "cell"), "id")
    at = found.join(sample.select(F.col("id").alias("query_id"), "v"), "query_id").select("v", "cell").mapInArrow(places, "place long").agg(F.percentile("place", target).alias("p")).first()["p"]
    return max(1, int(np.ceil(at))) if at is not None else PROBES


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """n_queries, recall: how much of the exact result (query_id, id) was found, by its distances' k-th place.

    A found vector counts if it is no farther than the exact k-th, so that ties can't lower the recall.
    """
    last = exact.groupBy("query_id").agg(F.max("distance").alias("last"), F.count(F.lit(1)).alias("n"))
    hit = found.join(last, "query_id", "right").groupBy("query_id").agg(F.max("n").alias("n"), F.count_if(F.col("distance") <= F.col("last")).alias("hit"))
    return hit.agg(F.count(F.lit(1)).alias("n_queries"), (F.sum(F.least("hit", "n")) / F.sum("n")).alias("recall"))
