"""End-to-end plans: compare two arms, break the comparison down by domain, write the summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.functions.keys import FALLBACK_REPO, compat_repo, owner, true_repo
from trialstats.functions.states import decision, fixed, percent, yes_no
from trialstats.operators.joins import attach_domain, latest
from trialstats.operators.passk import pass_at_all
from trialstats.operators.rates import RUN, breakdown, paired_counts, paired_rates, rates_of_counts, task_summary
from trialstats.plans.paired import paired_comparison
from trialstats.plans.running import join_null_safe
from trialstats.session import stored_table
from trialstats.sources.writers import metric_report

# Each gives every trial a key, so that all figures of a report cover the same trials.
_KEYS = {"owner": owner, "repo": lambda task: F.coalesce(true_repo(task), F.lit(FALLBACK_REPO)), "compat": compat_repo}


def with_key(trials: DataFrame, key: str = "repo", name: str = "pair_key", task: str = "task_id") -> DataFrame:
    """Add the key that rates are paired on: the true ``repo``, the ``owner``, or the ``compat`` key.

    No trial is left without one: ids of another form share a key, ``mock_owner/mock_project`` or ``Other``.
    """
    return trials.withColumn(name, _KEYS[key](task))


def compare_arms(
    trials: DataFrame,
    key: str = "repo",
    treatment: str = "final_state",
    control: str = "base_state",
    **options: object,
) -> DataFrame:
    """One row: the paired comparison of two arms over (key, run) rates."""
    keyed = with_key(trials, key)
    pairs = paired_rates(keyed, ["pair_key", RUN], treatment, control)
    return paired_comparison(pairs, **options)


def domain_table(
    trials: DataFrame,
    domains: DataFrame,
    key: str = "owner",
    default: str = "General Software Utilities",
    with_total: bool = False,
    unique: bool = False,
) -> DataFrame:
    """Per domain: number of tasks, rates of both arms and Pass@K. ``domains`` is (owner, domain)."""
    tasks = task_summary(trials).withColumn("owner", _KEYS[key]("task_id"))
    return breakdown(attach_domain(tasks, domains, default=default, unique=unique), "domain", with_total)


def domain_comparison(
    trials: DataFrame, domains: DataFrame, default: str = "General Software Utilities", **options: object
) -> DataFrame:
    """The domain table with the paired test of every domain, all domains in one job.

    Owners are looked up once they are reduced to rates, one row per owner and run.
    """
    lookup = stored_table(latest(domains, "owner", "domain"))
    pairs = paired_rates(with_key(trials, "owner", "owner"), ["owner", RUN])
    named = attach_domain(pairs, lookup, default=default, unique=True)
    tests = paired_comparison(named, group_cols=["domain"], **options)
    return join_null_safe(domain_table(trials, lookup, default=default, unique=True), tests, ["domain"])


def summary_row(
    trials: DataFrame, key: str = "repo", alpha: float = 0.05, floor: float = 16.06, **options: object
) -> DataFrame:
    """One row: macro rates of both arms, Pass@K, the paired comparison and the decision.

    The trials are read twice: once into counts per key and run, which are stored and give both the
    pairs and the rates of whole runs, and once per task for Pass@K.
    """
    keyed = with_key(trials, key)
    counted = stored_table(keyed.groupBy("pair_key", RUN).agg(*paired_counts()))
    pairs = rates_of_counts(counted, ["pair_key", RUN])
    sums = [F.sum(c).alias(c) for c in ("n_failing", "n_rescued", "n_control")]
    runs = rates_of_counts(counted.groupBy(RUN).agg(*sums), [RUN])
    means = runs.agg(F.struct(F.avg("f2p_treatment").alias("t"), F.avg("f2p_control").alias("c"))).scalar()
    return (
        paired_comparison(pairs, **options)
        .withColumn("_means", means)
        .withColumns({"treatment_f2p": F.col("_means.t"), "control_f2p": F.col("_means.c")})
        .drop("_means")
        .withColumn("pass_at_all", pass_at_all(trials).select("pass_at_all").scalar())
        .withColumn("rejected", decision("p_value", "treatment_f2p", alpha, floor))
    )


# Names of the summary report, in order, and the text column each one shows.
SUMMARY_METRICS: Sequence[tuple[str, str]] = (
    ("Agentic_F2P_Avg_Pass@1", "treatment_text"),
    ("Agentic_F2P_Pass@3", "passk_text"),
    ("Baseline_F2P_Avg", "control_text"),
    ("N_Observations", "n_pairs"),
    ("p-value", "p_text"),
    ("Effect_Size_Cliffs_Delta", "delta_text"),
    ("Effect_Size_Description", "effect"),
    ("Reject_H0", "reject_text"),
)


def summary_report(row: DataFrame, metrics: Sequence[tuple[str, str]] = SUMMARY_METRICS) -> DataFrame:
    """(Metric, Value) rows of a summary row: numbers become texts only here."""
    texts = (
        row.withColumn("treatment_text", percent("treatment_f2p"))
        .withColumn("passk_text", percent("pass_at_all"))
        .withColumn("control_text", percent("control_f2p"))
        .withColumn("p_text", fixed("p_value", 6))
        .withColumn("delta_text", fixed("cliffs_delta", 4))
        .withColumn("reject_text", yes_no("rejected"))
    )
    return metric_report(texts, metrics)
