"""Pass@k: is a task solved in any of its first k runs. Initial states play no part here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialstats.functions.states import rate, succeeded
from trialstats.operators.rates import RUN, group_known


def solved_tasks(trials: DataFrame, task: str = "task_id", keys: Sequence[str] = ()) -> DataFrame:
    """One row per task: did any of its runs pass."""
    return group_known(trials, [*keys, task], [F.max(succeeded()).alias("solved")])


def pass_at_all(trials: DataFrame, task: str = "task_id", keys: Sequence[str] = ()) -> DataFrame:
    """Share of tasks with any passing run, overall or per key."""
    solved = solved_tasks(trials, task, keys)
    return (
        solved.groupBy(*keys)
        .agg(F.count("*").alias("n_tasks"), F.count_if("solved").alias("n_solved"))
        .select(*keys, "n_tasks", "n_solved", rate(F.col("n_solved"), F.col("n_tasks")).alias("pass_at_all"))
    )


def pass_at_k(trials: DataFrame, ks: Sequence[int], task: str = "task_id", keys: Sequence[str] = ()) -> DataFrame:
    """Pass@k for each of ``ks``: one pass, from the first passing run of each task.

    Runs are counted by ``sample_index``, so a task that lacks run 1 has not passed by run 1. Use
    ``first_k_repeats`` beforehand to count the runs a task really has.
    """
    first = group_known(trials, [*keys, task], [F.min(F.when(succeeded(), F.col(RUN))).alias("first_pass")])
    counted = first.groupBy(*keys).agg(
        F.count("*").alias("n_tasks"),
        *[F.count_if(F.col("first_pass") <= k).alias(f"_by_{k}") for k in ks],
    )
    curve = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(f"_by_{k}").alias("n_solved")) for k in ks]
    )
    return counted.select(*keys, "n_tasks", F.inline(curve)).select(
        *keys, "k", "n_tasks", "n_solved", rate(F.col("n_solved"), F.col("n_tasks")).alias("pass_at_k")
    )


def first_k_repeats(trials: DataFrame, k: int, task: str = "task_id") -> DataFrame:
    """The first k trials of each task by run, numbered in ``repeat``.

    The rank filter lets Spark keep only k rows per task and partition before the shuffle, so a task
    with very many trials is cut down where they are read. Equal runs are told apart by their states.
    """
    order = Window.partitionBy(task).orderBy(RUN, "initial_state", "final_state")
    return (
        trials.filter(F.col(task).isNotNull())
        .withColumn("repeat", F.row_number().over(order))
        .filter(F.col("repeat") <= k)
    )


def first_outcomes(trials: DataFrame, task: str = "task_id") -> DataFrame:
    """States of the earliest run of each task, and its number of trials; the same on every run."""
    earliest = F.min(F.struct(RUN, "initial_state", "final_state")).alias("_first")
    return group_known(trials, [task], [earliest, F.count("*").alias("n_trials")]).select(
        task, "_first.initial_state", "_first.final_state", "n_trials"
    )
