"""Queries that SQL can say, row by row against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from trialstats.llm import registered


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_twin(spark, tiny, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tiny}/{table}.parquet'")
    theirs = con.sql(registered.SQL[name])
    wanted = [dict(zip(theirs.columns, row, strict=True)) for row in theirs.fetchall()]
    ours = [row.asDict() for row in registered.QUERIES[name](spark, tiny).collect()]
    assert sorted(str(sorted(r.items())) for r in ours) == sorted(str(sorted(r.items())) for r in wanted)
