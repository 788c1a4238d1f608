"""Every registered query runs, and gives the rows of its SQL where it has one."""

import datetime

import duckdb
import pytest

from webloom.catalog import ORACLES, QUERIES, flagship

BASE = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "events", "conversations", "customer")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: round(x, 6) if isinstance(x, float) else x.isoformat() if isinstance(x, datetime.datetime) else x
    return sorted(([cell(r[i]) for i in order] for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, BASE)
    found = [tuple(r) for r in got.collect()]
    assert found
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, found) == rows(want.columns, want.fetchall())


def test_flagship(spark):
    assert flagship(spark, BASE).count() > 5
