"""Paired signed-rank test and Cliff's delta for all groups in one job.

Both need only running totals over distinct values: average ranks come from how many absolute
differences are smaller, and dominance counts from how many values of the other arm are smaller.
So pairs are first reduced to value counts (copies are combined before the shuffle), and the cost
is that of sorting distinct values; no pair of pairs is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.states import effect_label
from trialstats.plans.exact_tail import exact_tails
from trialstats.plans.running import join_null_safe, running_totals
from trialstats.session import stored_table

ALL, PART = "_all", "_part"
_EXACT = "decimal(38,0)"  # counts of pairs of trials outgrow 64 bits

DIFFERENCE, LEVEL = "difference", "level"

# Up to so many differing pairs a group's ranks are one short array; beyond, its tail is a job of its own.
_FEW_PAIRS = 50


def normal_upper_tail(z: str) -> Column:
    """P(Z > z) to about 12 digits, far tails included: half of erfc(z / sqrt 2), by built-in functions.

    Near the middle erfc is 1 minus a series of positive terms. Further out that difference would
    lose all its digits, so the continued fraction of erfc is used there.
    """
    x = f"(abs({z}) / sqrt(2D))"
    bell = f"(exp(-{x} * {x}) / sqrt(pi()))"
    series = f"""aggregate(sequence(1, 80), struct({x} AS term, {x} AS total),
        (acc, n) -> struct(acc.term * 2D * {x} * {x} / (2D * n + 1D) AS term,
                           acc.total + acc.term * 2D * {x} * {x} / (2D * n + 1D) AS total),
        acc -> acc.total)"""
    fraction = f"aggregate(sequence(80, 1), 0D, (acc, n) -> (n / 2D) / ({x} + acc))"
    tail = f"(CASE WHEN {x} < 2D THEN 0.5D - {bell} * {series} ELSE 0.5D * {bell} / ({x} + {fraction}) END)"
    return F.expr(f"CASE WHEN {z} < 0D THEN 1D - {tail} ELSE {tail} END")


def paired_comparison(
    pairs: DataFrame,
    treatment: str = "f2p_treatment",
    control: str = "f2p_control",
    group_cols: Sequence[str] = (),
    tie_decimals: int | None = None,
    exact_up_to: int = 50,
    method: str = "auto",
    scale: str = "code",
    with_p: bool = True,
) -> DataFrame:
    """One row per group: numbers of pairs, mean rates, W+, z, one-tailed p, Cliff's delta and label.

    Zero differences are dropped and equal absolute differences share their average rank. Differences
    are raw doubles, so ties are float ties; ``tie_decimals`` rounds them first. ``method`` is
    ``auto`` (exact p up to ``exact_up_to`` differing pairs, else the normal approximation with tie
    correction and no continuity correction), ``exact`` whatever the number of pairs (the work grows with its
    square: some 1e7 coefficients for 5,000 pairs), or ``asymptotic``. ``p_method`` says which was used.
    A group whose differences are all zero has W+ 0 and p 1.
    """
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"method must be auto, exact or asymptotic, not {method}")
    groups = list(group_cols)
    keys = groups or [ALL]
    ranked = _ranked_values(pairs, treatment, control, groups, tie_decimals)
    few = 0 if method == "asymptotic" or not with_p else _FEW_PAIRS if method == "exact" else min(exact_up_to, _FEW_PAIRS)
    tree = with_p and (method == "exact" or method == "auto" and exact_up_to > _FEW_PAIRS)
    if tree:
        ranked = stored_table(ranked)
    stats = _statistics(ranked, keys, few)
    if with_p:
        n = F.col("n_nonzero")
        exact = F.lit(method == "exact") | (F.lit(method == "auto") & (n <= exact_up_to))
        stats = _with_p(stats, ranked if tree else None, keys, few, exact).withColumn("p_method", F.when(exact, "exact").otherwise("asymptotic"))
    return stats.withColumn("effect", effect_label("cliffs_delta", scale)).select(
        *groups,
        "n_pairs",
        "n_nonzero",
        "mean_treatment",
        "mean_control",
        "w_plus",
        "w_minus",
        "z",
        *(["p_value", "p_method"] if with_p else []),
        "sign_sum",
        "cliffs_delta",
        "effect",
    )


def signed_ranks(
    pairs: DataFrame,
    treatment: str = "f2p_treatment",
    control: str = "f2p_control",
    group_cols: Sequence[str] = (),
    tie_decimals: int | None = None,
) -> DataFrame:
    """Distinct non-zero absolute differences with their average rank, and pairs above and below."""
    groups = list(group_cols)
    ranked = _ranked_values(pairs, treatment, control, groups, tie_decimals)
    return ranked.filter(F.col(PART) == DIFFERENCE).select(
        *groups,
        F.col("_value").alias("abs_diff"),
        F.col("_up").alias("n_up"),
        F.col("_down").alias("n_down"),
        F.expr(f"{_DOUBLED_RANK} / 2D").alias("avg_rank"),
    )


def cliffs_delta(
    samples: DataFrame,
    value: str,
    arm: str,
    treatment: str,
    control: str,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Cliff's delta of two unpaired samples of any sizes, held in long form with an arm label.

    Wins, losses and ties over all pairs of the two samples come from running totals.
    """
    groups = list(group_cols)
    keys = groups or [ALL]
    sums = [F.sum(F.when(F.col(arm) == label, 1).otherwise(0)) for label in (treatment, control)]
    counted = (
        samples.filter(F.col(value).isNotNull() & F.col(arm).isin(treatment, control))
        .withColumn(ALL, F.lit(0))
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(sums[0].alias("_up"), sums[1].alias("_down"))
    )
    placed = running_totals(counted, keys, "_value", ["_up", "_down"])
    up, down = F.col("_up").cast(_EXACT), F.col("_down").cast(_EXACT)
    totals = placed.groupBy(*keys).agg(
        F.sum("_up").alias("n_treatment"),
        F.sum("_down").alias("n_control"),
        F.sum(up * F.col("_down_before").cast(_EXACT)).cast(_EXACT).alias("wins"),
        F.sum(up * down).cast(_EXACT).alias("ties"),
    )
    whole = F.col("n_treatment").cast(_EXACT) * F.col("n_control").cast(_EXACT)
    losses = whole - F.col("wins") - F.col("ties")
    return totals.withColumn("losses", losses.cast(_EXACT)).select(
        *groups,
        "n_treatment",
        "n_control",
        "wins",
        "losses",
        "ties",
        F.try_divide((F.col("wins") - F.col("losses")).cast("double"), whole.cast("double")).alias("cliffs_delta"),
    )


def _ranked_values(
    pairs: DataFrame, treatment: str, control: str, groups: Sequence[str], tie_decimals: int | None
) -> DataFrame:
    """Value counts of differences and of levels in one table, with running totals.

    In the ``difference`` part a row is an absolute difference, ``_up`` / ``_down`` the pairs where the
    treatment is above / below. In the ``level`` part a row is a rate, counted for either arm.
    """
    t, c = F.col(treatment).cast("double"), F.col(control).cast("double")
    d = t - c if tie_decimals is None else F.round(t - c, tie_decimals)
    keys = list(groups) or [ALL]
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def entry(part: str, value: Column, up: Column, down: Column) -> Column:
        return F.struct(F.lit(part).alias(PART), value.alias("_value"), up.alias("_up"), down.alias("_down"))

    entries = F.array(
        entry(DIFFERENCE, F.abs(d), (d > 0).cast("bigint"), (d < 0).cast("bigint")),
        entry(LEVEL, t, one, zero),
        entry(LEVEL, c, zero, one),
    )
    counted = (
        pairs.filter(t.isNotNull() & c.isNotNull())
        .withColumn(ALL, F.lit(0))
        .select(*keys, F.inline(entries))
        .filter((F.col(PART) == LEVEL) | (F.col("_value") != 0))
        .groupBy(*keys, PART, "_value")
        .agg(F.sum("_up").alias("_up"), F.sum("_down").alias("_down"))
    )
    return running_totals(counted, [*keys, PART], "_value", ["_up", "_down"])


# Twice the average rank of an absolute difference: an integer, ties or not.
_DOUBLED_RANK = "(2 * (_up_before + _down_before) + _up + _down + 1)"


def _statistics(ranked: DataFrame, keys: Sequence[str], exact_up_to: int) -> DataFrame:
    up, down, rank2 = (f"CAST({c} AS {_EXACT})" for c in ("_up", "_down", _DOUBLED_RANK))
    tied = f"CAST(_up + _down AS {_EXACT})"
    below = f"CAST(2 * _down_before + _down AS {_EXACT})"

    def exact(condition: str, what: str) -> str:
        return f"CAST(coalesce(sum(CASE WHEN {condition} THEN CAST({what} AS {_EXACT}) END), 0) AS {_EXACT})"

    here, level = f"{PART} = '{DIFFERENCE}'", f"{PART} = '{LEVEL}'"
    sums = {
        "n_pairs": f"coalesce(sum(CASE WHEN {level} THEN _up END), 0)",
        "n_nonzero": f"coalesce(sum(CASE WHEN {here} THEN _up + _down END), 0)",
        "_sum_t": f"sum(CASE WHEN {level} THEN _value * _up END)",
        "_sum_c": f"sum(CASE WHEN {level} THEN _value * _down END)",
        "_w2": exact(here, f"{up} * {rank2}"),
        "_l2": exact(here, f"{down} * {rank2}"),
        "_tie_term": exact(here, f"{tied} * {tied} * {tied} - {tied}"),
        # Treatment wins minus losses = sum(up * (2 * below + equal)) - n * n.
        "_dominance": exact(level, f"{up} * {below}"),
    }
    if exact_up_to:
        # Only groups that get an exact p collect their ranks.
        few = f"{here} AND _up_total + _down_total <= {exact_up_to}"
        copies = f"array_repeat(CAST({_DOUBLED_RANK} AS INT), CAST(_up + _down AS INT))"
        sums["_ranks2"] = f"flatten(collect_list(CASE WHEN {few} THEN {copies} END))"

    n = "CAST(n_nonzero AS DOUBLE)"
    pairs = f"CAST(n_pairs AS {_EXACT})"
    sign_sum = f"(_dominance - {pairs} * {pairs})"
    variance = f"({n} * ({n} + 1) * (2 * {n} + 1) / 24D - CAST(_tie_term AS DOUBLE) / 48D)"
    shown = {
        "n_pairs": "n_pairs",
        "n_nonzero": "n_nonzero",
        "_w2": "_w2",
        "mean_treatment": "try_divide(_sum_t, n_pairs)",
        "mean_control": "try_divide(_sum_c, n_pairs)",
        "w_plus": "CAST(_w2 AS DOUBLE) / 2D",
        "w_minus": "CAST(_l2 AS DOUBLE) / 2D",
        "z": f"try_divide(CAST(_w2 AS DOUBLE) / 2D - {n} * ({n} + 1) / 4D, sqrt({variance}))",
        "sign_sum": f"CAST({sign_sum} AS {_EXACT})",
        "cliffs_delta": f"try_divide(CAST({sign_sum} AS DOUBLE), CAST({pairs} * {pairs} AS DOUBLE))",
    }
    return (
        ranked.groupBy(*keys)
        .agg(*[F.expr(sql).alias(name) for name, sql in sums.items()])
        .selectExpr(
            *[f"`{k}`" for k in keys],
            *[f"{sql} AS {name}" for name, sql in shown.items()],
            *(["_ranks2"] if exact_up_to else []),
        )
    )


def _with_p(stats: DataFrame, ranked: DataFrame | None, keys: Sequence[str], few: int, exact: Column) -> DataFrame:
    """Adds ``p_value``: of the ranks themselves for small groups, by the product tree for larger ones (of ``ranked``), normal for all others."""
    n, normal = F.col("n_nonzero"), normal_upper_tail("z")
    small = F.when(n <= few, exact_upper_tail("_ranks2", "CAST(_w2 AS INT)")) if few else F.lit(None)
    stats = stats.withColumn("p_value", F.when(n == 0, 1.0).when(exact & (n <= few), small).when(~exact, normal))
    if ranked is None:
        return stats
    stats = stored_table(stats.drop("_ranks2"))
    large = stats.filter("p_value IS NULL").select(*keys, F.col("_w2").alias("w2"))
    if large.isEmpty():
        return stats
    here = ranked.filter(F.col(PART) == DIFFERENCE)
    ranks = here.select(*keys, F.expr(_DOUBLED_RANK).alias("r"), F.expr("_up + _down").alias("m"), F.expr("_up_before + _down_before").alias("before"))
    tails = exact_tails(join_null_safe(ranks, large.select(*keys), keys), large, keys)
    beside = stats.filter("p_value IS NULL").drop("p_value")
    return stats.filter("p_value IS NOT NULL").unionByName(join_null_safe(beside, tails.withColumnRenamed("p_exact", "p_value"), keys))


def exact_upper_tail(ranks2: str, w2: str) -> Column:
    """P(doubled W+ >= w2) when every rank takes either sign with equal chance.

    Holds the chance of every sum: a rank shifts them by itself or leaves them, each with half the weight, so
    nothing outgrows a double. Doubled average ranks are integers, so ties are exact.
    """
    none = f"array_repeat(0D, CAST(size({ranks2}) * (size({ranks2}) + 1) AS INT))"
    chances = f"""aggregate({ranks2}, concat(array(1D), {none}), (ways, r) ->
        transform(ways, (p, i) -> (p + CASE WHEN i >= r THEN get(ways, i - r) ELSE 0D END) / 2D))"""
    return F.expr(f"aggregate(slice({chances}, {w2} + 1, size({ranks2}) * (size({ranks2}) + 1) + 1), 0D, (total, p) -> total + p)")
