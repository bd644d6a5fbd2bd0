"""Distinct counts that add up: theta sketches per group, merged to larger groups and compared between arms.

An exact distinct count shuffles every value and cannot be added up: the count of an owner is not the sum of those of
its runs. A sketch of a group is a few kilobytes whatever the group holds, is combined before the shuffle, can be
stored beside daily results, and sketches of any groups give those of their unions, intersections and differences.

A sketch that has seen up to ``2 ** precision`` distinct values is exact. Beyond, its relative standard error is
``2 ** (-precision / 2)``, 1.6 % for the default. The error of a common or a lone part is that share of the *union*.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 12


def sketch_name(column: str) -> str:
    """Name of the column that holds the sketch of ``column``."""
    return f"{column}_sketch"


def distinct_sketches(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], precision: int = PRECISION
) -> DataFrame:
    """One row per key: a sketch of the distinct values of each column, as ``<column>_sketch``.

    Nulls are not counted, nor are empty texts, which a sketch does not take. Null keys are a group of their own.
    """
    made = [F.theta_sketch_agg(F.col(c), precision).alias(sketch_name(c)) for c in columns]
    return df.groupBy(*keys).agg(*made)


def merged_sketches(
    sketches: DataFrame, keys: Sequence[str], columns: Sequence[str], precision: int = PRECISION
) -> DataFrame:
    """Sketches of larger groups, from stored sketches of their parts; parts may overlap."""
    merged = [F.theta_union_agg(F.col(sketch_name(c)), precision).alias(sketch_name(c)) for c in columns]
    return sketches.groupBy(*keys).agg(*merged)


def sketched_counts(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``n_<column>``: the number of distinct values each sketch stands for."""
    return sketches.select(*keys, *[F.theta_sketch_estimate(sketch_name(c)).alias(f"n_{c}") for c in columns])


def overlap(
    left: DataFrame, right: DataFrame, keys: Sequence[str], column: str, names: tuple[str, str] = ("left", "right")
) -> DataFrame:
    """Per key, distinct values of two arms: ``n_common``, ``n_only_<left>``, ``n_only_<right>`` and ``n_either``.

    Each arm holds one row of sketches per key. A key that one arm lacks counts as an empty sketch there.
    """
    name = sketch_name(column)
    a, b = F.col("_a"), F.col("_b")
    sides = (
        left.select(*keys, F.col(name).alias("_one"), F.lit(0).alias("_side"))
        .unionByName(right.select(*keys, F.col(name).alias("_one"), F.lit(1).alias("_side")))
        .groupBy(*keys)
        .agg(*[F.theta_union_agg(F.when(F.col("_side") == n, F.col("_one"))).alias(c) for n, c in enumerate(("_a", "_b"))])
    )
    size = F.theta_sketch_estimate
    return sides.select(
        *keys,
        size(F.theta_intersection(a, b)).alias("n_common"),
        size(F.theta_difference(a, b)).alias(f"n_only_{names[0]}"),
        size(F.theta_difference(b, a)).alias(f"n_only_{names[1]}"),
        size(F.theta_union(a, b)).alias("n_either"),
    )
