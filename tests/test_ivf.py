"""The inverted file against the whole scan: exact where asked, recall where not, hot cells, odd vectors."""

import math
import os

import numpy as np
import pytest

from evigraph.operators import ivf
from evigraph.operators import retrieval as R
from evigraph.plans import retrieval

SF = "/root/testdata/sf0.001"


def _vectors(n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))
    x[: n // 3] = x[0]  # a third of all vectors are one
    return [(i, row.tolist()) for i, row in enumerate(x)]


def _told(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["distance"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_exact_search_equals_the_scan(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(ivf, "PART_ROWS", 50)
    v = spark.createDataFrame(_vectors(), "id long, v array<double>").repartition(4)
    index = ivf.build(v, str(tmp_path / "i"), metric=metric)
    assert index.cells.count() == 600 and index.sizes.sum() == 600
    q = v.filter("id % 20 = 0")
    exact = R.knn(q, v, 7, metric).cache()
    for probes in (1, 3):
        assert _told(ivf.search(q, index, 7, probes, exact=True)) == _told(exact)
    near = ivf.search(q, index, 7, 4)
    assert ivf.recall(near, exact, 7).first()["recall"] >= 0.9
    r = ivf.recall(exact.limit(0), exact, 7).first()
    assert (r["n_queries"], r["recall"]) == (30, 0.0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_recall_of_the_query(spark):
    r = retrieval.vec_ivf_recall(spark, SF).first()
    assert r["n_queries"] == 25 and r["recall"] >= 0.9


def test_probes_are_measured(spark, tmp_path):
    v = spark.createDataFrame(_vectors(300), "id long, v array<double>")
    index = ivf.build(v, str(tmp_path / "i"))
    probes = ivf.tune(v, index, 5, 1.0)
    exact = R.knn(v, v, 5)
    assert 1 <= probes <= len(index.centres) and ivf.recall(ivf.search(v, index, 5, probes), exact, 5).first()["recall"] == 1.0
    assert ivf.tune(v.limit(0), index, 5) == ivf.PROBES


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    inf, nan = math.inf, math.nan
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [1.0, None]), (None, [1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (9, [])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    for metric in ("l2sq", "cosine"):
        index = ivf.build(v, str(tmp_path / metric), metric=metric)
        assert _told(ivf.search(v, index, 20, 1, exact=True)) == _told(R.knn(v, v, 20, metric))
    assert ivf.search(v.limit(0), index, 3).isEmpty()
    none = ivf.build(v.limit(0), str(tmp_path / "none"))
    assert ivf.search(v, none, 3, exact=True).isEmpty()


def test_cells_of_few_vectors():
    x = np.repeat(np.eye(3), 5, axis=0)
    assert len(ivf.kmeans(x, 8)) == 3 and {tuple(c) for c in ivf.kmeans(x, 3)} == {tuple(r) for r in np.eye(3)}
