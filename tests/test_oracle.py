"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from evigraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(cols, want.fetchall())
