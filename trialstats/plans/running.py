"""Running totals over a sorted value histogram without a one-task window and with one range shuffle.

``Window.orderBy`` with no partition sends every row to a single task, and a window per group does
the same for a group that holds most of the rows. Here the histogram (one row per group and value)
is range-partitioned and sorted, and each range is totalled where it lies, by the task that writes it.
Only the first and the last group of a range can go on in another one: their totals, at most two
rows per range, are carried from range to range and added when the stored rows are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.session import remove_stored, stored_table

CHUNK = "_chunk"

# Rows in one range, which its task holds as columns: the number of ranges follows from counted rows.
RANGE_ROWS = 250_000

# Where a group lies in its range: all others are whole inside it.
_PLACE, _LAST_ROW = "_place", "_last_row"
_INNER, _HEAD, _TAIL = 0, 1, 2


def _starts_of_groups(rows: pa.Table, groups: Sequence[str]) -> np.ndarray:
    """Positions of sorted rows whose group differs from the row before; null equals null, NaN equals NaN."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for name in groups:
        column = rows.column(name).combine_chunks()
        here, before = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.not_equal(here, before)
        if pa.types.is_floating(column.type):
            differs = pc.and_(differs, pc.invert(pc.and_(pc.is_nan(here), pc.is_nan(before))))
        differs = pc.if_else(pc.or_(here.is_null(), before.is_null()), pc.xor(here.is_null(), before.is_null()), differs)
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _totalled(groups: Sequence[str], sum_cols: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Totals inside one sorted range: before each row of its group, and over the group."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        starts = _starts_of_groups(rows, groups)
        sizes = np.diff(starts, append=rows.num_rows)
        last = np.zeros(rows.num_rows, dtype=bool)
        last[starts + sizes - 1] = True
        place = np.full(len(starts), _INNER, dtype=np.int32)
        place[-1], place[0] = _TAIL, _HEAD
        for c in sum_cols:
            values = rows.column(c).cast(pa.int64()).fill_null(0).to_numpy()
            upto = np.cumsum(values)
            before = upto - values
            whole = np.add.reduceat(values, starts)
            rows = rows.append_column(f"{c}_before", pa.array(before - np.repeat(before[starts], sizes)))
            rows = rows.append_column(f"{c}_total", pa.array(np.repeat(whole, sizes)))
        rows = rows.append_column(CHUNK, pa.array(np.full(rows.num_rows, TaskContext.get().partitionId(), dtype=np.int32)))
        rows = rows.append_column(_PLACE, pa.array(np.repeat(place, sizes)))
        rows = rows.append_column(_LAST_ROW, pa.array(last))
        yield from rows.to_batches(max_chunksize=65_536)

    return total


def stored_in_ranges(
    histogram: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    sum_cols: Sequence[str],
    chunks: int | None = None,
) -> DataFrame:
    """The histogram in stored ranges by group and value, with totals inside each range.

    ``histogram`` must hold one row per (group, value), as an aggregation leaves it: that is what
    keeps the ranges even however often a value was repeated. It is stored and counted first, so that
    the ranges are as many as its rows ask for, and that their borders are found from stored rows.
    """
    groups = list(group_cols)
    counted = stored_table(histogram)
    ranges = chunks or max(1, -(-counted.count() // RANGE_ROWS))
    ranged = counted.repartitionByRange(ranges, *groups, value_col).sortWithinPartitions(*groups, value_col)
    long, number = T.LongType(), T.IntegerType()
    fields = [T.StructField(f"{c}_{what}", long) for c in sum_cols for what in ("before", "total")]
    places = [T.StructField(CHUNK, number), T.StructField(_PLACE, number), T.StructField(_LAST_ROW, T.BooleanType())]
    schema = T.StructType([*counted.schema.fields, *fields, *places])
    stored = stored_table(ranged.mapInArrow(_totalled(groups, list(sum_cols)), schema))
    remove_stored(counted)
    return stored


def carried_totals(ranged: DataFrame, group_cols: Sequence[str], sum_cols: Sequence[str]) -> DataFrame:
    """For the first and last group of each range: ``<c>_carried`` from ranges before it, ``<c>_whole`` over all ranges.

    At most two rows per range, and in each window at most one.
    """
    groups = list(group_cols)
    earlier = Window.partitionBy(*groups).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    return ranged.filter(F.col(_LAST_ROW) & (F.col(_PLACE) != _INNER)).select(
        CHUNK,
        _PLACE,
        *[F.coalesce(F.sum(f"{c}_total").over(earlier), F.lit(0)).alias(f"{c}_carried") for c in sum_cols],
        *[F.sum(f"{c}_total").over(whole).alias(f"{c}_whole") for c in sum_cols],
    )


def totals_in_ranges(ranged: DataFrame, group_cols: Sequence[str], sum_cols: Sequence[str]) -> DataFrame:
    """Add what was carried to the totals inside ranges; ``ranged`` is a ``stored_in_ranges``.

    Rows meet the carried totals by the number of their range. Those are stored first, so that Spark knows their
    size when it plans the join.
    """
    added = {f"{c}_{what}" for c in sum_cols for what in ("before", "total")}
    carried = stored_table(carried_totals(ranged, group_cols, sum_cols))
    return ranged.join(carried, [CHUNK, _PLACE], "left").select(
        *[c for c in ranged.columns if c not in {CHUNK, _PLACE, _LAST_ROW} | added],
        *[(F.col(f"{c}_before") + F.coalesce(f"{c}_carried", F.lit(0))).alias(f"{c}_before") for c in sum_cols],
        *[F.coalesce(f"{c}_whole", f"{c}_total").alias(f"{c}_total") for c in sum_cols],
    )


def running_totals(
    histogram: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    sum_cols: Sequence[str],
    chunks: int | None = None,
) -> DataFrame:
    """Add ``<c>_before`` for each of ``sum_cols``, its total over smaller values of the same group, and
    ``<c>_total``, its total over the group, to a histogram of one row per (group, value).

    Sums are whole numbers of 64 bits; a null counts as 0. ``chunks`` sets the number of ranges.
    """
    ranged = stored_in_ranges(histogram, group_cols, value_col, sum_cols, chunks)
    return totals_in_ranges(ranged, group_cols, sum_cols)


def attach_to_groups(
    rows: DataFrame, per_group: DataFrame, keys: Sequence[str], spread_by: str, salts: int = 32
) -> DataFrame:
    """Give every row the values of its group; ``per_group`` holds one row per group.

    Each group is dealt over ``salts`` join keys, so that one with most of the rows is split: ``per_group`` is
    repeated per salt, and ``spread_by`` is the column whose hash deals the rows, one with many distinct
    values inside a group. Spark may still broadcast ``per_group`` where its bytes allow it.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    return join_null_safe(dealt, per_group.withColumn("_salt", salt), [*keys, "_salt"]).drop("_salt")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a null key matches a null key, as grouping treats them."""
    a, b = left.alias("_a"), right.alias("_b")
    same = reduce(lambda x, y: x & y, [F.col(f"_a.`{k}`").eqNullSafe(F.col(f"_b.`{k}`")) for k in keys])
    return a.join(b, same, "inner").select(
        *[F.col(f"_a.`{c}`") for c in left.columns], *[F.col(f"_b.`{c}`") for c in right.columns if c not in keys]
    )
