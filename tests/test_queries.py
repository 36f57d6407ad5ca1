"""Every registered query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from textloom import plans

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(tuple(cell(v) for v in r) for r in got.select(*cols).toPandas().itertuples(index=False))
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql).df()
    assert sorted(want.columns) == cols
    assert rows == sorted(tuple(cell(v) for v in r) for r in want[cols].itertuples(index=False))


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
