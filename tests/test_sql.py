"""Registered queries against their SQL, on the smallest data."""

from pathlib import Path

import pandas as pd
import pytest

import importlib

import __spark_entry__ as entry
from lectern.plans import base

DATA = Path("/root/testdata/sf0.001")
for _m in entry.CORE:
    importlib.import_module(f"lectern.plans.{_m}")


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, str) or type(v).__name__ in ("bool", "bool_"):
        return str(v)
    try:
        return round(float(v), 8)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(base.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    got, want = base.QUERIES[name](spark, str(DATA)).toPandas(), con.sql(base.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
