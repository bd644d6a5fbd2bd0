"""Text and row expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` does that for plain ASCII, several times faster than ``translate``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, A_TO_Z, A_TO_Z.lower()))


def same(left: str, right: str, names: Sequence[str]) -> Column:
    """Join condition on columns of two aliases in which null matches null."""
    pairs = [F.col(f"{left}.`{n}`").eqNullSafe(F.col(f"{right}.`{n}`")) for n in names]
    return reduce(lambda x, y: x & y, pairs)


def with_keys(docs: DataFrame, **keys: Column) -> DataFrame:
    """``_row``, all columns of ``docs``, beside ``keys``: a column of any name may be among the former."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[k.alias(n) for n, k in keys.items()])


def without_keys(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def join_same(rows: DataFrame, other: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Join on equal ``names``, null matching null; keeps the columns of ``rows``, then the new ones."""
    a, b = rows.alias("_a"), other.alias("_b")
    joined = a.join(b, same("_a", "_b", names), how)
    new = [] if how in ("left_semi", "left_anti") else [c for c in other.columns if c not in names]
    return joined.select(*[F.col(f"_a.`{c}`") for c in rows.columns], *[F.col(f"_b.`{c}`") for c in new])
