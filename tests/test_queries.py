"""The core's queries against their SQL over the smallest tables, where these are at hand."""

import glob
import math
import os

import pytest

from leafloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    return v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalogue.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    b = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_without_sql(spark, name):
    catalogue.QUERIES[name](spark, FOLDER).collect()
