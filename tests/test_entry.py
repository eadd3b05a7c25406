import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((str(tuple(norm(r[c]) for c in columns)) for r in df.collect()))
    out = duck.sql(entry.oracle_sql()[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert got == sorted(str(tuple(norm(r[i]) for i in at)) for r in out.fetchall())


def test_entry(spark):
    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("the given tables are not there")
    assert entry.entry(spark).count() > 0
