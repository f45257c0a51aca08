"""Every core query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog

SF = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in SF.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) & set(catalog.oracle_sql())))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, str(SF))
    r = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(row[columns.index(c)]) for c in sorted(columns)) for row in r.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in sorted(columns)) for row in df.collect()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
