"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def tidy(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, sf, tables, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(str([tidy(r[c]) for c in cols]) for r in df.collect())
    result = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert rows == sorted(str([tidy(r[names.index(c)]) for c in cols]) for r in result.fetchall())


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
