"""Every core query against its SQL on the smallest tables, over all rows."""

import pathlib

import duckdb
import pytest

from tessera.plans import catalogue

TABLES = pathlib.Path("/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in TABLES.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def told(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, str(TABLES))
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(told, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(told, r)) for r in result.fetchall())


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalogue.queries()) - set(SQL)):
        assert catalogue.queries()[name](spark, str(TABLES)).count() >= 0, name
