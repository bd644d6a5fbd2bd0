"""Fail-to-pass rates. All are counts combined before the shuffle, so no key is too hot.

The rate of a set of trials is ``100 * (failing at first and passing at last) / (failing at first)``,
and 0.0 for a set with no failing trial.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.states import initially_failing, is_invalid, rate, succeeded
from trialstats.schema import FAIL, INVALID, PASS

RUN = "sample_index"


def counts(final: str = "final_state") -> list[Column]:
    """Aggregates ``n_failing`` and ``n_rescued`` of one arm."""
    return [
        F.count_if(initially_failing()).alias("n_failing"),
        F.count_if(initially_failing() & succeeded(final)).alias("n_rescued"),
    ]


def group_known(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregate per key, without the groups that have a null key.

    They are dropped by a count after the aggregation: a filter on a computed key would be pushed to
    the scan and compute the key a second time for every row.
    """
    if not keys:
        return df.agg(*aggregates)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.groupBy(*keys).agg(*aggregates, F.count_if(known).alias("_known")).filter("_known > 0").drop("_known")


def f2p(trials: DataFrame, keys: Sequence[str] = (), final: str = "final_state", value: str = "f2p") -> DataFrame:
    """Rate per key, or one pooled (micro) rate. Rows with a null key are left out."""
    return group_known(trials, keys, counts(final)).select(
        *keys, "n_failing", "n_rescued", rate(F.col("n_rescued"), F.col("n_failing")).alias(value)
    )


def f2p_by_run(trials: DataFrame, final: str = "final_state") -> DataFrame:
    """Rate of every run, in one pass over the trials."""
    return f2p(trials, [RUN], final)


def macro_average(rates: DataFrame, value: str = "f2p", alias: str = "macro_f2p") -> DataFrame:
    """Mean of per-key rates: every key weighs the same, whatever its size."""
    return rates.agg(F.avg(value).alias(alias))


def micro_average(trials: DataFrame, final: str = "final_state", alias: str = "micro_f2p") -> DataFrame:
    """Pooled rate: every trial weighs the same."""
    return f2p(trials, (), final, alias)


def arms_long(trials: DataFrame, arms: Mapping[str, str], arm_col: str = "arm") -> DataFrame:
    """Both arms of a wide table in long form, from a single scan: one row per trial and arm.

    ``arms`` maps an arm label to its final-state column; the column becomes ``final_state``.
    """
    others = [c for c in trials.columns if c not in arms.values()]
    entries = F.array(
        *[F.struct(F.lit(arm).alias(arm_col), F.col(state).alias("final_state")) for arm, state in arms.items()]
    )
    return trials.select(*others, F.inline(entries))


def paired_counts(control: str = "base_state", treatment: str = "final_state") -> list[Column]:
    """Aggregates ``n_failing``, ``n_rescued`` and ``n_control``, for two arms held in the same rows."""
    return [*counts(treatment), F.count_if(initially_failing() & succeeded(control)).alias("n_control")]


def rates_of_counts(
    counted: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("f2p_treatment", "f2p_control")
) -> DataFrame:
    """Rates of both arms from ``paired_counts`` columns."""
    return counted.select(
        *keys,
        rate(F.col("n_rescued"), F.col("n_failing")).alias(names[0]),
        rate(F.col("n_control"), F.col("n_failing")).alias(names[1]),
    )


def paired_rates(
    trials: DataFrame,
    keys: Sequence[str],
    treatment: str = "final_state",
    control: str = "base_state",
    names: tuple[str, str] = ("f2p_treatment", "f2p_control"),
) -> DataFrame:
    """Rates of two arms held in the same rows: one aggregate, no join.

    Equal to ``pair_arms`` over the two separate rate tables.
    """
    return rates_of_counts(group_known(trials, keys, paired_counts(control, treatment)), keys, names)


def task_summary(trials: DataFrame, task: str = "task_id", control: str | None = "base_state") -> DataFrame:
    """One row per task with everything the breakdowns add up: counts, and whether any run passed."""
    return group_known(
        trials,
        [task],
        [
            F.count("*").alias("n_trials"),
            *(paired_counts(control) if control else counts()),
            F.max(succeeded()).alias("solved"),
            F.max(is_invalid()).alias("any_invalid"),
        ],
    )


def breakdown(tasks: DataFrame, key: str, with_total: bool = False) -> DataFrame:
    """Per group of tasks: tasks, control rate, pass@1 rate and pass@K share; optionally a total row.

    ``tasks`` is a ``task_summary`` with a group column. The total is rolled up from the group rows
    and has ``is_total`` set, so a group that is itself null stays apart from it.
    """
    arms = ["n_failing", "n_rescued", *(["n_control"] if "n_control" in tasks.columns else [])]
    groups = group_known(
        tasks,
        [key],
        [F.count("*").alias("tasks"), *[F.sum(c).alias(c) for c in arms], F.count_if("solved").alias("n_solved")],
    )
    if with_total:
        groups = groups.rollup(key).agg(
            *[F.sum(c).alias(c) for c in ["tasks", *arms, "n_solved"]], (F.grouping(key) == 1).alias("is_total")
        )
    return groups.select(
        key,
        *(["is_total"] if with_total else []),
        "tasks",
        *[
            rate(F.col(c), F.col("n_failing")).alias(name)
            for c, name in (("n_control", "control_f2p"), ("n_rescued", "pass1_f2p"))
            if c in arms
        ],
        rate(F.col("n_solved"), F.col("tasks")).alias("passk_rate"),
    )


def funnel(first_outcomes: DataFrame, n_rows: str = "n_trials") -> DataFrame:
    """One row: raw trials, tasks, initially failing, rescued, invalid, rate.

    ``first_outcomes`` holds one row per task with its first states and its number of trials.
    """
    return first_outcomes.agg(
        F.coalesce(F.sum(n_rows), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_tasks"),
        *counts(),
        F.count_if(is_invalid()).alias("n_invalid"),
    ).select("*", rate(F.col("n_rescued"), F.col("n_failing")).alias("f2p"))


def invalid_count(trials: DataFrame) -> DataFrame:
    return trials.agg(F.count_if(is_invalid()).alias("n_invalid"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of distinct values of each column; the approximate form needs no shuffle of the values."""
    how = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[how(c).alias(f"n_{c}") for c in columns])


def transitions(trials: DataFrame) -> DataFrame:
    """Initial states down, final states across; states outside the vocabulary count as ``other``."""
    known = F.when(F.col("final_state").isin(PASS, FAIL, INVALID), F.col("final_state")).otherwise("other")
    return (
        trials.withColumn("_final", known)
        .groupBy("initial_state")
        .pivot("_final", [PASS, FAIL, INVALID, "other"])
        .count()
        .select(
            "initial_state",
            *[F.coalesce(F.col(s), F.lit(0)).alias(f"to_{s.lower()}") for s in (PASS, FAIL, INVALID, "other")],
        )
    )


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each label; the percentages add up to 100.

    The total is a scalar subquery over the same counts, whose shuffle both of them use.
    """
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.select(column, "n", rate(F.col("n"), total).alias("share"))


def task_outcomes(tasks: DataFrame) -> DataFrame:
    """Outcome label per task: solved, else why not."""
    label = F.when(F.col("solved"), "solved").when(F.col("any_invalid"), "invalid run").otherwise("unsolved")
    return tasks.withColumn("outcome", label)
