"""Queries of this subpackage that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from lodegraph.llm import entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = con.sql(entry.SQL[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in places)) for r in want.fetchall())
