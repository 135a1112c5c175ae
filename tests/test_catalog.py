"""Every named query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from skerry.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("embeddings", "events", "lineitem", "nation", "orders", "part", "supplier")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, rows) == _rows(want.columns, want.fetchall())
