"""Every driver query with SQL against DuckDB, and the entry point's contract."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from lumenfold import queries, sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return c


def comparable(rows, columns, order):
    return sorted(tuple("~" if r[columns.index(c)] is None else str(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    df, expected = queries.queries()[name](spark, SF), tables.sql(sql.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(expected.columns) == order
    assert comparable(df.collect(), df.columns, order) == comparable(expected.fetchall(), expected.columns, order)


def test_queries_without_sql_run(spark):
    for name in set(queries.queries()) - set(sql.oracle_sql()):
        assert queries.queries()[name](spark, SF).count() >= 0


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(queries.queries()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
