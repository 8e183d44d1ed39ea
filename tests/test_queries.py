"""Every registered query runs on the smallest tables; every oracle query
agrees with DuckDB there (the driver repeats this at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in sdf.collect()]
    assert len(set(sdf.columns)) == len(sdf.columns)
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(cols) == sorted(sdf.columns)
    assert len(rows) == len(drows)
    assert digest(sdf.columns, rows)[0] == digest(cols, drows)[0]
