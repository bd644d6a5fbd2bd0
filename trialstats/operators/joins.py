"""Lookups, arm pairing, id selection and repeat expansion.

No join carries a broadcast hint. Spark broadcasts a side only where its size estimate, or the size
seen at run time, is below ``spark.sql.autoBroadcastJoinThreshold``; beyond that it sort-merges and
splits hot keys (``spark.sql.adaptive.skewJoin``). That splitting needs a plain shuffle on both sides,
which a freshly aggregated side does not have: so a lookup is reduced to one row per key and stored
before it is joined. Rate operators count before they look up, so the fact side of their joins holds
one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.functions.keys import DEFAULT_DOMAIN, compat_repo
from trialstats.session import stored_table


def latest(lookup: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """One row per key: the value with the highest ``order`` (ties: the highest value).

    An aggregate rather than a window, so copies of a hot key are merged before the shuffle.
    """
    ranked = F.struct(F.col(order), F.col(value)) if order else F.struct(F.col(value))
    return (
        lookup.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(ranked).alias("_latest"))
        .select(key, F.col(f"_latest.{value}").alias(value))
    )


def attach_repo(
    trials: DataFrame,
    lookup: DataFrame,
    id_col: str = "task_id",
    lookup_id: str = "instance_id",
    repo_col: str = "repo",
    order: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add the repository of each trial: from the lookup, else computed from the task id.

    Where the lookup repeats a key, its last row by ``order`` wins. ``unique`` says that it repeats none.
    """
    found = (lookup if unique else stored_table(latest(lookup, lookup_id, repo_col, order))).select(
        F.col(lookup_id).alias(id_col), F.col(repo_col).alias("_found")
    )
    return (
        trials.join(found, id_col, "left")
        .withColumn(repo_col, F.coalesce("_found", compat_repo(id_col)))
        .drop("_found")
    )


def attach_domain(
    df: DataFrame,
    lookup: DataFrame,
    owner_col: str = "owner",
    domain_col: str = "domain",
    default: str = DEFAULT_DOMAIN,
    order: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add the domain of each owner from a lookup table, with a default for unknown owners.

    Where the lookup repeats a key, its last row by ``order`` wins. ``unique`` says that it repeats none.
    """
    found = (lookup if unique else stored_table(latest(lookup, owner_col, domain_col, order))).select(
        owner_col, F.col(domain_col).alias("_found")
    )
    return (
        df.join(found, owner_col, "left")
        .withColumn(domain_col, F.coalesce("_found", F.lit(default)))
        .drop("_found")
    )


def pair_arms(
    treatment: DataFrame,
    control: DataFrame,
    keys: Sequence[str],
    value: str = "f2p",
    names: tuple[str, str] = ("f2p_treatment", "f2p_control"),
) -> DataFrame:
    """Rates of both arms side by side, for keys that both have. Each side holds one row per key."""
    left = treatment.select(*keys, F.col(value).alias(names[0]))
    right = control.select(*keys, F.col(value).alias(names[1]))
    return left.join(right, list(keys), "inner")


def pair_arms_outer(
    treatment: DataFrame,
    control: DataFrame,
    keys: Sequence[str],
    value: str = "f2p",
    names: tuple[str, str] = ("f2p_treatment", "f2p_control"),
) -> DataFrame:
    """Pairs by key with the unmatched keys of both arms kept and named in ``matched``.

    Pairing two lists by position gives the same pairs only while both hold the same keys.
    """
    left = treatment.select(*keys, F.col(value).alias(names[0]), F.lit(True).alias("_t"))
    right = control.select(*keys, F.col(value).alias(names[1]), F.lit(True).alias("_c"))
    return (
        left.join(right, list(keys), "full_outer")
        .withColumn(
            "matched",
            F.when(F.col("_c").isNull(), "treatment_only").when(F.col("_t").isNull(), "control_only").otherwise("both"),
        )
        .drop("_t", "_c")
    )


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """All rows whose id is among ``ids``."""
    return df.join(ids.select(id_col), id_col, "left_semi")


def expand_repeats(tasks: DataFrame, end: int, start: int = 1, run_col: str = "sample_index") -> DataFrame:
    """One row per task and run from ``start`` to ``end``, both included."""
    if end < start:
        return tasks.withColumn(run_col, F.lit(None).cast("int")).limit(0)
    return tasks.withColumn(run_col, F.explode(F.sequence(F.lit(start), F.lit(end))))
