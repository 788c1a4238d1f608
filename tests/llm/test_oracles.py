"""Every SQL of this subpackage gives its query's rows."""

import duckdb
import pytest

from webloom.llm.queries import ORACLES, QUERIES


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(([cell(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    base = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, base)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
