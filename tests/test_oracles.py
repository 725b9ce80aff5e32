"""Every core query that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from glossaloom.plans.queries import ORACLES, QUERIES
from tests.conftest import SF


def plain(v):
    return None if v is None or v != v else int(v) if isinstance(v, float) and v.is_integer() else v


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(v) for v in r]) for r in frame.astype(object).where(frame.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    frame = QUERIES[name](spark, sf)
    assert frame.count() >= 0 and frame.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
