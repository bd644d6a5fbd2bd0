"""The registry of checked queries, and the rounding both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL twin where there is one."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return query

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: two engines may differ in the last digit of a floating aggregate."""
    if not any(isinstance(f.dataType, T.DoubleType) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
