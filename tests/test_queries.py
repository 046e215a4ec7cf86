"""Registered queries of the engine against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from sparkdraw.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*[[round(v, 9) if isinstance(v, float) else v for v in table.column(n).to_pylist()] for n in names], strict=True)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toArrow(), db.sql(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry_names():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
