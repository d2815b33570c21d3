"""The driver contract, and every registered query against its DuckDB oracle
on the smallest scale factor (exact values, any order)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from featureflow.plans.queries import REGISTRY

from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    return (1, repr(v))


def _bag(records, cols):
    return sorted(tuple(_canon(r[c]) for c in cols) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["event_id", "ts", "user_id", "event_type", "value", "props"]


def test_every_query_of_the_library_has_an_oracle():
    assert set(REGISTRY) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF001)
    cols = sorted(got.columns)
    want = duck.execute(E.oracle_sql()[name])
    want_cols = [d[0] for d in want.description]
    assert cols == sorted(want_cols)
    want_rows = [dict(zip(want_cols, r)) for r in want.fetchall()]
    got_rows = [r.asDict() for r in got.collect()]
    assert len(got_rows) == len(want_rows)
    assert _bag(got_rows, cols) == _bag(want_rows, cols)
