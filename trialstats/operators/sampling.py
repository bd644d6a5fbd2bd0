"""Exact seeded samples and shards, without a global sort in one task.

Ids or rows are ordered by md5 of ``seed|id``. Where a sample ends is found by radix select over the hex digits of the hash: counts per
prefix say which prefix holds the end, and only what has that prefix is counted by the next digits, until few are
left or all are alike. Only those are ranked; all with a smaller prefix are in the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.functions.hashing import key_hash
from trialstats.operators.joins import keep_ids
from trialstats.plans.running import attach_to_groups, running_totals
from trialstats.session import stored_table

_HASH, _PREFIX, _LEFT, _ALL = "_hash", "_prefix", "_left", "_stratum_of_all"

# Hex digits that are counted at a time, and rows of a stratum that are ranked at the end.
STEP, RANKED = 3, 10_000
# Sorts behind every hex digit.
_WHOLE = "~"


def _ends(rows: DataFrame, strata: Sequence[str], wanted: Column, length: int) -> DataFrame:
    """Per stratum the prefix at which the first ``wanted`` rows end, and how many of the rows with that prefix are among them.

    ``wanted`` may use ``_total``. Strata that are to be taken whole have a prefix behind all others.
    """
    done: DataFrame | None = None
    state, depth = None, 0
    while True:
        depth = min(depth + STEP, length)
        here = rows
        if state is not None:
            here = attach_to_groups(rows, state, strata, _HASH).filter(F.startswith(_HASH, F.col(_PREFIX))).drop(_PREFIX)
        keys = [*strata, *([] if state is None else [_LEFT])]
        counted = here.groupBy(*keys, F.substring(_HASH, 1, depth).alias(_PREFIX)).agg(
            F.count("*").alias("_n"), (F.min(_HASH) == F.max(_HASH)).alias("_alike")
        )
        # A row for each of the prefixes of one step.
        each = Window.partitionBy(*strata)
        placed = counted.select(
            "*",
            F.coalesce(F.sum("_n").over(each.orderBy(_PREFIX).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.sum("_n").over(each).alias("_total"),
        )
        left = (wanted if state is None else F.col(_LEFT)).cast("bigint")
        placed = placed.withColumn(_LEFT, left)
        holds = (F.col("_before") < F.col(_LEFT)) & (F.col(_LEFT) <= F.col("_before") + F.col("_n"))
        whole = (F.col("_before") == 0) & (F.col(_LEFT) > F.col("_total"))
        found = placed.filter(holds | whole).select(
            *strata,
            F.when(whole, _WHOLE).otherwise(F.col(_PREFIX)).alias(_PREFIX),
            F.when(whole, F.lit(0)).otherwise(F.col(_LEFT) - F.col("_before")).alias(_LEFT),
            (whole | (F.col("_n") <= RANKED) | F.col("_alike") | F.lit(depth == length)).alias("_found"),
        )
        found = stored_table(found)
        ended = found.filter("_found").drop("_found")
        done = ended if done is None else done.unionByName(ended)
        state = found.filter("NOT _found").drop("_found")
        if state.isEmpty():
            return done


def _split(rows: DataFrame, strata: Sequence[str], wanted: Column, length: int) -> tuple[DataFrame, DataFrame]:
    """Rows that are in the sample, and those of which the first ``_left`` are."""
    placed = attach_to_groups(rows, _ends(rows, strata, wanted, length), strata, _HASH)
    prefix = F.expr(f"substring({_HASH}, 1, length({_PREFIX}))")
    return placed.filter(prefix < F.col(_PREFIX)).drop(_PREFIX, _LEFT), placed.filter(prefix == F.col(_PREFIX)).drop(_PREFIX)


def _sample(df: DataFrame, id_col: str, wanted: Column, strata: Sequence[str], seed: int | str) -> DataFrame:
    """The first ``wanted`` distinct ids (per stratum) in hash order; ``wanted`` may use ``_total``."""
    keys = list(strata) or [_ALL]
    ids = df.withColumn(_ALL, F.lit(0)).select(*keys, id_col).filter(F.col(id_col).isNotNull()).distinct()
    inside, edge = _split(ids.withColumn(_HASH, key_hash([id_col], seed)), keys, wanted, 32)
    ranked = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(_HASH, id_col)))
    ended = ranked.filter(F.col("_rank") <= F.col(_LEFT)).drop("_rank", _LEFT)
    return inside.unionByName(ended).select(*strata, id_col)


def sample_ids(df: DataFrame, id_col: str, fraction: float, seed: int | str = 42) -> DataFrame:
    """Exactly ``round(fraction * n)`` of the n distinct ids (an exact half goes to the even number)."""
    return _sample(df, id_col, F.bround(F.col("_total") * F.lit(fraction)), (), seed)


def sample_fraction(df: DataFrame, id_col: str, fraction: float, seed: int | str = 42) -> DataFrame:
    """All rows of an exact fraction of the distinct ids."""
    return keep_ids(df, sample_ids(df, id_col, fraction, seed), id_col)


def sample_n(df: DataFrame, id_col: str, n: int, seed: int | str = 42) -> DataFrame:
    """Exactly ``n`` rows, the whole table where it has no more than that.

    Rows are ordered by the hash of their id, then by one of all their columns; ids may be null or repeated. Rows that are
    equal in all columns are counted, not told apart, so one that is there over and over is no hot key.
    """
    columns = df.columns
    row = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in columns])), 16, "0")
    hashed = df.withColumn(_HASH, F.concat(key_hash([id_col], seed), F.lower(row))).withColumn(_ALL, F.lit(0))
    inside, edge = _split(hashed, [_ALL], F.lit(n), 48)
    counted = edge.groupBy(_ALL, _LEFT, _HASH, *columns).agg(F.count("*").alias("_copies"))
    before = F.sum("_copies").over(Window.partitionBy(_ALL).orderBy(_HASH, *columns).rowsBetween(Window.unboundedPreceding, -1))
    taken = F.least(F.col("_copies"), F.col(_LEFT) - F.coalesce(before, F.lit(0)))
    ended = counted.withColumn("_taken", taken).filter("_taken > 0")
    ended = ended.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_taken"))))
    return inside.select(*columns).unionByName(ended.select(*columns))


def sample_strata(df: DataFrame, id_col: str, stratum: str, fraction: float, seed: int | str = 42) -> DataFrame:
    """Ids with ``ceil(fraction * n)`` of the n ids of every stratum."""
    return _sample(df, id_col, F.ceil(F.col("_total") * F.lit(fraction)), (stratum,), seed)


def round_robin_shards(df: DataFrame, id_col: str, shards: int, chunks: int | None = None) -> DataFrame:
    """Distinct ids in order, dealt to shards 0, 1, .., so that shard sizes differ by at most one.

    ``hash_shard`` needs no order and no shuffle; use it where the sizes may differ a little.
    """
    ids = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.lit(1).cast("bigint").alias("_one"))
    return running_totals(ids, [], id_col, ["_one"], chunks).select(
        id_col, F.pmod("_one_before", F.lit(shards)).cast("int").alias("shard")
    )
