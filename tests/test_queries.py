"""Every registered query with SQL gives the rows of that SQL; no plan holds a cross join."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def db(sf):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    mine = [tuple(r) for r in df.collect()]
    ran = db.execute(ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, mine) == rows_of(names, ran.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rows_only(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, sf).limit(1).count() == 1, name


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "item_id" in df.columns
