"""Exact quantiles, dispersion, box-plot and histogram series.

A mergeable KLL sketch of each group says between which two values a wanted position lies, with a margin far beyond its error.
A second pass counts what is below and tells apart the values in between, so the result is exact, and whether the bracket held the
position is checked by these counts. Brackets of groups that are too large for that are narrowed by sketches of what is
inside them first. Nothing is sorted but the values of a bracket, and no table of the rows is written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.plans.running import attach_to_groups, join_null_safe
from trialstats.session import stored_table

ALL = "_all"

# Size of a sketch; groups of up to half as many values need none.
SKETCH = 4096
# By how much of a group a bracket goes beyond the sketch's answer on either side; its error is about an eighth of that.
MARGIN = 0.01
# Shares of a sketch that are asked for; a bracket begins and ends at one of them.
GRID = 400
# Distinct values of a bracket that are listed in one row.
LISTED = 100_000


def value_counts(df: DataFrame, value: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per group and non-null value with its number of rows ``n``, combined before the shuffle."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group_cols, F.col(value).cast("double").alias(value))
        .agg(F.count("*").alias("n"))
    )


def _first_pass(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: its moments, ends and sketch, all combined before the shuffle."""
    v = F.col("_v")
    return stored_table(
        rows.groupBy(*keys).agg(
            F.count("*").alias("n_values"),
            F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("sd"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias("_sketch"),
        )
    )


def _grid(sketch: str) -> Column:
    """The sketch's values at even shares of its values, from the first to the last."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))


def _places(probs: Sequence[float]) -> Column:
    """The position of each probability, from 0: the values on either side of it are wanted."""
    place = (F.col("n_values") - 1).cast("double")
    one = [F.struct(F.lit(i).alias("i"), F.floor(place * p).alias("first"), F.ceil(place * p).alias("last")) for i, p in enumerate(probs)]
    return F.explode(F.array(*one)).alias("_p")


# A bracket holds all of ``inside`` values from ``low`` to ``high``, with ``below`` smaller ones; the next is from ``next_low`` to ``next_high``.
_KNOWN = ("i", "first", "last", "below", "inside", "low", "high", "margin")


def _with_next(brackets: DataFrame) -> DataFrame:
    """The next bracket around each position, from the sketch of this one; small ones are taken whole."""
    few = F.col("inside") <= SKETCH // 2

    def at(place: Column, beyond: Column) -> Column:
        inside = F.element_at("_grid", F.greatest(F.least(place, F.lit(GRID)), F.lit(0)).cast("int") + 1)
        return F.when(few | (place < 0) | (place > GRID), beyond).otherwise(inside)

    share = [(F.col(c) + side - F.col("below")) / F.col("inside") for c, side in (("first", 0), ("last", 1))]
    places = [F.floor((share[0] - F.col("margin")) * GRID), F.ceil((share[1] + F.col("margin")) * GRID)]
    return (
        brackets.withColumn("_grid", _grid("_sketch"))
        .withColumns({"next_low": at(places[0], F.col("low")), "next_high": at(places[1], F.col("high"))})
        .drop("_grid", "_sketch")
    )


def _in_brackets(rows: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row beside the brackets of its group that it lies in; a group with most of the rows is split."""
    others = [c for c in brackets.columns if c not in keys]
    listed = brackets.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("_brackets"))
    held = F.filter("_brackets", lambda b: (b["low"] <= F.col("_v")) & (F.col("_v") <= b["next_high"]))
    return attach_to_groups(rows, listed, keys, "_v").select(*keys, "_v", F.explode(held).alias("_b")).select(*keys, "_v", "_b.*")


def _narrowed(rows: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brackets that hold their positions, counted; where the next one did not, the old one with a wider margin."""
    inside = F.col("_v") >= F.col("next_low")
    counted = _in_brackets(rows, brackets, keys).groupBy(*keys, *_KNOWN, "next_low", "next_high").agg(
        F.count_if(~inside).alias("_less"), F.count_if(inside).alias("_in"), F.kll_sketch_agg_double(F.when(inside, F.col("_v")), F.lit(SKETCH)).alias("_sketch")
    )
    less = F.col("below") + F.col("_less")
    good = (less <= F.col("first")) & (F.col("last") < less + F.col("_in"))
    kept = {"below": less, "inside": F.col("_in"), "low": F.col("next_low"), "high": F.col("next_high")}
    moved = counted.select(
        *keys, "i", "first", "last", *[F.when(good, new).otherwise(F.col(c)).alias(c) for c, new in kept.items()],
        F.when(good, F.lit(MARGIN)).otherwise(F.col("margin") * 4).alias("margin"), F.when(good, F.col("_sketch")).alias("_sketch"),
    )
    # Where there is no new sketch, all that is known is the old bracket: it is taken whole.
    after = _with_next(moved)
    wider = [F.coalesce(f"next_{c}", c).alias(f"next_{c}") for c in ("low", "high")]
    return stored_table(after.select(*keys, *_KNOWN, *wider))


def _value_at(position: str) -> Column:
    """Of ``_listed`` values with their numbers, in order, the one that ``position`` falls on."""
    start = F.struct(F.col("below") + F.col("_less"), F.lit(None).cast("double"))
    found = F.aggregate(
        "_listed",
        F.struct(start["col1"].alias("done"), start["col2"].alias("value")),
        lambda held, x: F.struct((held["done"] + x["n"]).alias("done"), F.when((held["done"] <= F.col(position)) & (F.col(position) < held["done"] + x["n"]), x["_v"]).otherwise(held["value"]).alias("value")),
    )
    return found["value"]


def _picked(rows: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``low_value`` and ``high_value`` of each position, null where the next bracket did not hold it."""
    inside = F.col("_v") >= F.col("next_low")
    counted = _in_brackets(rows, brackets, keys).groupBy(*keys, *_KNOWN, "next_low", "next_high", F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("n"))
    listed = counted.groupBy(*keys, *_KNOWN, "next_low", "next_high").agg(
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("n"))), F.lit(0)).alias("_less"),
        F.sort_array(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_v", "n")))).alias("_listed"),
    )
    return stored_table(listed.select(*keys, *_KNOWN, "next_low", "next_high", _value_at("first").alias("low_value"), _value_at("last").alias("high_value")))


def _quantile_rows(rows: DataFrame, groups: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``keys, i, low_value, high_value`` for each group and probability."""
    out = ("i", "low_value", "high_value")
    placed = groups.select(*keys, "n_values", "min", "max", "_sketch", _places(probs)).select("*", "_p.*")
    brackets = placed.select(
        *keys, "i", "first", "last", F.lit(0).cast("bigint").alias("below"), F.col("n_values").alias("inside"),
        F.col("min").alias("low"), F.col("max").alias("high"), F.lit(MARGIN).alias("margin"), "_sketch",
    )
    found: list[DataFrame] = []
    brackets = stored_table(_with_next(brackets).select(*keys, *_KNOWN, "next_low", "next_high"))
    while True:
        # A bracket of one value needs no list, however many rows have it.
        listed = F.least(F.col("inside") * 3 * F.col("margin"), F.col("inside"))
        much = (F.col("next_low") < F.col("next_high")) & (F.col("inside") > SKETCH // 2)
        most = brackets.agg(F.max(F.when(much, listed).otherwise(0.0))).first()[0]
        if most is None:
            break
        if most > LISTED:
            brackets = _narrowed(rows, brackets, keys)
            continue
        picked = _picked(rows, brackets, keys)
        found.append(picked.filter("low_value IS NOT NULL AND high_value IS NOT NULL").select(*keys, *out))
        missed = picked.filter("low_value IS NULL OR high_value IS NULL")
        # The sketch was further off than its margin: the bracket before is known to hold the position.
        brackets = missed.select(*keys, *_KNOWN[:-1], (F.col("margin") * 4).alias("margin"), F.col("low").alias("next_low"), F.col("high").alias("next_high"))
    if not found:
        return groups.limit(0).select(*keys, F.lit(0).alias("i"), F.col("min").alias("low_value"), F.col("max").alias("high_value"))
    return reduce(DataFrame.unionByName, found)


def _summaries(df: DataFrame, value: str, group_cols: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that count (keys and ``_v``), and moments, ends and quantiles of each group."""
    keys = list(group_cols) or [ALL]
    v = F.col(f"`{value}`").cast("double")
    rows = df.withColumn(ALL, F.lit(0)).select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    groups = _first_pass(rows, keys)
    each = _quantile_rows(rows, groups, keys, probs)

    def between(i: int, p: float) -> Column:
        place = (F.col("n_values") - 1).cast("double") * p
        low, high = (F.max(F.when(F.col("i") == i, F.col(c))) for c in ("low_value", "high_value"))
        return low + (high - low) * (F.max(place) - F.floor(F.max(place)))

    joined = join_null_safe(each, groups.drop("_sketch"), keys)
    moments = ("n_values", "mean", "sd", "min", "max")
    return rows, joined.groupBy(*keys, *moments).agg(*[between(i, p).alias(name) for i, (p, name) in enumerate(zip(probs, names))])


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str], group_cols: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group; no task holds a whole group. Nulls and NaN are left out."""
    return _summaries(df, value, group_cols, probs, names)[1].select(*group_cols, *names)


def dispersion(df: DataFrame, value: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean, median, population deviation, quartiles, minimum and maximum, one row per group. Nulls and NaN are left out."""
    found = _summaries(df, value, group_cols, (0.25, 0.5, 0.75), ("p25", "median", "p75"))[1]
    return found.select(*group_cols, "n_values", "mean", "median", "sd", "p25", "p75", "min", "max")


def box_plot(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 quartile ranges) and number of outliers per group."""
    rows, found = _summaries(df, value, [group], (0.25, 0.5, 0.75), ("q1", "median", "q3"))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("_v")
    inside = v.between(F.col("q1") - fence, F.col("q3") + fence)
    return (
        attach_to_groups(rows, stored_table(found.select(group, "q1", "median", "q3")), [group], "_v")
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """Counts in equal bins over [min, max]; the last bin is closed, empty bins count zero.

    A single value gets a range of one around it. The value counts are stored, so that ``df`` is read
    once, and the range is a scalar subquery over them.
    """
    counted = stored_table(value_counts(df, value))
    ends = counted.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    flat = F.col("low") == F.col("high")
    ends = ends.select(
        F.struct(
            F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
            F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        ).alias("ends")
    )
    ranged = counted.withColumn("_ends", ends.scalar())
    width = (F.col("_ends.high") - F.col("_ends.low")) / F.lit(float(bins))
    place = F.floor((F.col(value) - F.col("_ends.low")) / width)
    filled = (
        ranged.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_ends", ends.scalar())
    return every.join(filled, "bin", "left").select(
        "bin",
        (F.col("_ends.low") + F.col("bin") * width).alias("bin_low"),
        (F.col("_ends.low") + (F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def ceiling_share(df: DataFrame, value: str, low: float, ceiling: float) -> DataFrame:
    """Number, capped mean, and percentage of values at the ceiling once held inside [low, ceiling]."""
    capped = F.greatest(F.least(F.col(value).cast("double"), F.lit(float(ceiling))), F.lit(float(low)))
    return df.filter(F.col(value).isNotNull()).agg(
        F.count("*").alias("n_values"),
        F.avg(capped).alias("mean_capped"),
        F.count_if(capped == float(ceiling)).alias("n_at_ceiling"),
        (F.avg((capped == float(ceiling)).cast("double")) * 100.0).alias("share_at_ceiling"),
    )
