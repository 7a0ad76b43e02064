"""Every query with SQL against DuckDB on the smallest tables; the entry runs."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from tracemend.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.7g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    ran = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(cell(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in ran.fetchall())
    assert sorted(tuple(cell(r[c]) for c in sorted(names)) for r in got.collect()) == want


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and {"recovered", "confidence", "provenance"} <= set(df.columns)


def test_names():
    q, o = driver.queries(), driver.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70
