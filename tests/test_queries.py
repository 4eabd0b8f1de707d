"""Registered queries against their oracles on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from corpuswright.plans import registry

ORACLES = registry.oracle_sql()


def _show(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(_show, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, db, name):
    got = registry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted(tuple(map(_show, r)) for r in got.select(*cols).collect())
    if name not in ORACLES:
        assert rows
        return
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(_show(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
