"""Every query with an SQL equivalent against DuckDB, and every other one for rows and a stable schema."""

import decimal
import math

import duckdb
import pytest

from vellum.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, con, name):
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in want.columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
