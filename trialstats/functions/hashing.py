"""Seeded draws as pure functions of the row key: the same on every run, engine and partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(keys: Sequence[str], seed: int | str | None = None) -> Column:
    """md5 text of ``seed|key|key..``; the seed is left out when None. Keys must not be null."""
    parts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *([] if seed is None else [F.lit(str(seed))]), *parts))


def uniform(keys: Sequence[str], seed: int | str | None = None) -> Column:
    """Uniform draw in [0, 1): the first 32 bits of the key hash."""
    return F.conv(F.substring(key_hash(keys, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_shard(key: str, shards: int) -> Column:
    """Shard number by key hash: no order, no shuffle; shard sizes are only about equal."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")
