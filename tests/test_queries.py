"""Every query with SQL against that SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from barsmith.plans import oracle


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 7) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_matches_sql(spark, data, sql, name):
    got = entry.queries()[name](spark, data)
    want = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    b = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in want.fetchall()), key=str)
    assert len(a) == len(b) and a == b
    spark.catalog.clearCache()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
