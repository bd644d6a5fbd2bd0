"""Every registered query gives the rows of its SQL twin."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from checks.registry import QUERIES


@pytest.fixture(scope="module")
def database(tiny):
    connection = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, tiny, database, name):
    ours = driver.queries()[name](spark, tiny).toPandas()
    twin = database.execute(driver.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(twin.columns)
    ours, twin = (d[columns].sort_values(columns).reset_index(drop=True) for d in (ours, twin))
    assert len(ours) == len(twin)
    assert len(ours) > 0
    for column in columns:
        assert all(same(a, b) for a, b in zip(ours[column], twin[column])), column


def test_entry(spark):
    row = driver.entry(spark).collect()
    assert len(row) == 1 and row[0].n_pairs > 0
