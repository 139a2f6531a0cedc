"""Every catalogue query against its DuckDB oracle on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from remuneria.plans import registry
from remuneria.sources.bindings import TABLES
from conftest import SF_SMALL


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(norm(r[i]) for i in order) for r in records]
    return [cols[i] for i in order], sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    sc, sr = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    rel = duck.sql(E.oracle_sql()[name])
    dc, dr = canon(rel.columns, rel.fetchall())
    assert sc == dc
    assert sr == dr


def test_every_query_runs_and_entry(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0
