"""Unions of shards and arms, key audits, orderings and top groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.schema import TRIAL_KEY


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """All rows of all shards, columns matched by name, missing ones null, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def union_arms(arms: Mapping[str, DataFrame], arm_col: str = "arm") -> DataFrame:
    """Separate arm tables in long form with a label."""
    return union_shards([df.withColumn(arm_col, F.lit(arm)) for arm, df in arms.items()])


def repeated_keys(df: DataFrame, keys: Sequence[str] = TRIAL_KEY) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def one_per_key(df: DataFrame, keys: Sequence[str] = TRIAL_KEY) -> DataFrame:
    """One row per key: the smallest by its other columns, so the choice is the same on every run.

    An aggregate, so copies of a hot key are merged before the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*others)).alias("_kept"))
        .select(*[F.col(c) if c in keys else F.col(f"_kept.{c}").alias(c) for c in df.columns])
    )


def sorted_trials(df: DataFrame, keys: Sequence[str] = TRIAL_KEY) -> DataFrame:
    """Rows in key order where all key columns are present, else as they are.

    The other columns break ties, so that rows of a repeated key may lie in several sort partitions.
    """
    if not set(keys) <= set(df.columns):
        return df
    return df.orderBy(*keys, *[c for c in df.columns if c not in keys])


def ranked_by(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """Rows by falling metric; ties in order of ``tie``."""
    return df.orderBy(F.desc(metric), tie)


def top_groups(df: DataFrame, metric: str, tie: str, n: int) -> DataFrame:
    """The n rows with the highest metric."""
    return ranked_by(df, metric, tie).limit(n)


def ordered_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order."""
    return df.select(column).distinct().orderBy(column)
