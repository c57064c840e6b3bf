"""Every query with an oracle gives DuckDB's rows on the smallest test tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def cell(v):
    if v is None or pd.isna(v):
        return "null"
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DIRECTORY}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DIRECTORY).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if not n.startswith("p")))
def test_runs(spark, name):
    rows = QUERIES[name](spark, DIRECTORY).toPandas()
    assert len(rows.columns) and len(rows)


def test_entry(spark):
    assert entry.entry(spark).schema.names
