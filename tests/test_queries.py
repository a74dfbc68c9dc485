"""Every registered graph query against its SQL, and the entry module."""

import glob
import os

import pytest

import __spark_entry__ as entry
from lattica import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _row(values):
    return repr(tuple(round(float(x), 6) if type(x).__name__ in ("float", "Decimal") else x for x in values))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    want = db.execute(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(_row(r[c] for c in cols) for r in df.collect()) == sorted(map(_row, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(queries.QUERIES)
