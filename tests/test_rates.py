"""Rates, Pass@k and breakdowns on hand-made cases and against counted figures of the test tables."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from checks import views
from trialstats.functions.keys import compat_repo, domain, issue_number, owner, padded_id, true_repo
from trialstats.functions.states import effect_label, fixed, outcome_state, percent, retryable
from trialstats.operators import joins, passk, rates, tables

TEN = [("fail", "pass"), ("fail", "fail"), ("pass", "pass"), ("fail", "pass"), ("fail", "fail")] + [
    ("fail", "fail"),
    ("pass", "pass"),
    ("fail", "pass"),
    ("fail", "fail"),
    ("fail", "fail"),
]


def test_self_check_rate(make_trials):
    trials = make_trials([(f"t{i}", 1, *states) for i, states in enumerate(TEN)])
    assert rows(rates.f2p(trials)) == [(8, 3, 37.5)]


def test_no_failing_rows_is_zero(make_trials):
    trials = make_trials([("a", 1, "pass", "pass"), ("b", 1, "pass", "fail")])
    assert rows(rates.f2p(trials)) == [(0, 0, 0.0)]
    assert rows(rates.f2p(make_trials([]))) == [(0, 0, 0.0)]


def test_invalid_and_null_are_no_success_but_count(make_trials):
    trials = make_trials([("a", 1, "fail", "INVALID"), ("a", 2, "fail", None), ("a", 3, "fail", "pass"), ("a", 4, None, "pass")])
    assert rows(rates.f2p(trials)) == [(3, 1, pytest.approx(100 / 3))]


def test_null_keys_are_left_out(make_trials):
    trials = make_trials([(None, 1, "fail", "pass"), ("a", 1, "fail", "pass")])
    assert rows(rates.f2p(trials, ["task_id"])) == [("a", 1, 1, 100.0)]
    assert rows(passk.pass_at_all(trials)) == [(1, 1, 100.0)]


def test_pass_at_k_after_an_invalid_run(make_trials):
    trials = make_trials([("a", 1, "fail", "INVALID"), ("a", 2, "fail", "pass")])
    curve = passk.pass_at_k(trials, [1, 2, 3]).select("k", "pass_at_k")
    assert rows(curve) == [(1, 0.0), (2, 100.0), (3, 100.0)]


def test_pass_at_k_ignores_initial_state(make_trials):
    trials = make_trials([("a", 1, "pass", "pass"), ("b", 1, "fail", "fail")])
    assert rows(passk.pass_at_all(trials)) == [(2, 1, 50.0)]


def test_pass_at_k_rises_and_meets_the_run_rate(spark, tiny):
    trials = views.trials(spark, tiny).withColumn("initial_state", F.lit("fail"))
    trials = tables.one_per_key(trials.select("task_id", "sample_index", "initial_state", "final_state"))
    firsts = passk.first_k_repeats(trials, 3).withColumn("sample_index", F.col("repeat"))
    curve = [r.pass_at_k for r in passk.pass_at_k(firsts, [1, 2, 3]).orderBy("k").collect()]
    assert curve == sorted(curve)
    first_run = rates.f2p_by_run(firsts).filter("sample_index = 1").first().f2p
    assert curve[0] == pytest.approx(first_run)


def test_first_outcomes_is_by_run(make_trials):
    trials = make_trials([("a", 2, "fail", "pass"), ("a", 1, "fail", "fail")])
    assert rows(passk.first_outcomes(trials)) == [("a", "fail", "fail", 2)]
    assert rows(rates.funnel(passk.first_outcomes(trials))) == [(2, 1, 1, 0, 0, 0.0)]


def test_unknown_final_states_are_kept(make_trials):
    trials = make_trials([("a", 1, "fail", "pass"), ("a", 2, "fail", "timeout"), ("a", 3, "fail", None)])
    assert rows(rates.transitions(trials)) == [("fail", 1, 0, 0, 2)]


def test_counted_figures_of_the_test_tables(spark, small):
    """The first three runs, as counted beforehand in two engines."""
    trials = views.trials(spark, small).filter("sample_index <= 3").cache()
    assert trials.count() == 25662
    assert rows(rates.distinct_counts(trials, ["task_id"])) == [(12339,)]
    assert rows(trials.groupBy("sample_index").count()) == [(1, 8590), (2, 8583), (3, 8489)]
    passes = trials.groupBy("sample_index").agg(
        F.count_if(F.col("final_state") == "pass"), F.count_if(F.col("base_state") == "pass")
    )
    assert rows(passes) == [(1, 1705, 1588), (2, 1793, 1645), (3, 1715, 1607)]
    curve = passk.pass_at_k(trials, [1, 2, 3]).select("k", "n_solved")
    assert rows(curve) == [(1, 1619), (2, 3156), (3, 4438)]
    tasks = views.repo_lookup(spark, small)
    assert tasks.count() == 9912
    unlisted = trials.select("task_id").distinct().join(tasks, F.col("task_id") == F.col("instance_id"), "left_anti")
    assert unlisted.count() == 4203
    trials.unpersist()


def test_ids(spark):
    ids = spark.createDataFrame([("a__b-1",), ("a_b",), ("a_1",), ("plain",), (None,), ("a__b_c-12",)], "id string")
    shown = ids.select(
        owner("id").alias("o"), compat_repo("id").alias("c"), true_repo("id").alias("r"), issue_number("id").alias("n")
    )
    assert [tuple(r) for r in shown.collect()] == [
        ("a", "a/", "a/b", 1),
        ("a", "a/b", None, None),
        ("a", "mock_owner/mock_project", None, None),
        ("Other", "mock_owner/mock_project", None, None),
        ("Other", "mock_owner/mock_project", None, None),
        ("a", "a/", "a/b_c", 12),
    ]


def test_domain_map(spark):
    owners = spark.createDataFrame([("kayak",), ("nobody",), (None,)], "owner string")
    assert [r.d for r in owners.select(domain("owner").alias("d")).collect()] == [
        "Database & Query Engines",
        "General Software Utilities",
        "General Software Utilities",
    ]


def test_padded_ids_keep_long_numbers(spark):
    numbers = spark.createDataFrame([(7,), (12345,)], "n long")
    assert [r.i for r in numbers.select(padded_id("n").alias("i")).collect()] == ["task_0007", "task_12345"]


@pytest.mark.parametrize("value", [35.054, 3.125, 9.375, 0.0, 100.0, 71.585, 2.675, 99.995, 99.999, 12.5, -3.125, 1e-9, 0.00005, 7.0])
def test_fixed_decimals_as_printf(spark, value):
    row = spark.createDataFrame([(value,)], "x double").select(percent("x").alias("p"), fixed("x", 4).alias("f")).first()
    assert row.p == f"{value:.2f}%"
    assert row.f == f"{value:.4f}"


def test_effect_scales(spark):
    deltas = spark.createDataFrame([(0.1,), (-0.3018,), (0.6,), (None,)], "d double")
    shown = deltas.select(effect_label("d").alias("a"), effect_label("d", "paper").alias("b")).collect()
    assert [tuple(r) for r in shown] == [("Negligible", "Negligible"), ("Medium", "Small"), ("Large", "Large"), (None, None)]


def test_retryable_and_outcome(spark):
    errors = spark.createDataFrame([("HTTP 429",), ("Connection reset",), ("bad request",), (None,)], "e string")
    assert [r.x for r in errors.select(retryable("e").alias("x")).collect()] == [True, True, False, False]
    replies = spark.createDataFrame(
        [("a", "b", None, True), ("a", "b", "", False), (None, "b", None, True), ("a", None, None, True), ("a", "b", "503", True)],
        "r1 string, r2 string, e string, v boolean",
    )
    states = replies.select(outcome_state("r1", "r2", "e", "v").alias("s")).collect()
    assert [r.s for r in states] == ["pass", "fail", "INVALID", "INVALID", "INVALID"]


def test_lookup_last_entry_wins_and_default(spark, make_trials):
    lookup = spark.createDataFrame([("x__y-1", "old/r", 1), ("x__y-1", "new/r", 2)], "instance_id string, repo string, n int")
    trials = make_trials([("x__y-1", 1, "fail", "pass"), ("p_q", 1, "fail", "pass")])
    found = joins.attach_repo(trials, lookup, order="n").select("task_id", "repo")
    assert rows(found) == [("p_q", "p/q"), ("x__y-1", "new/r")]


def test_outer_pairs_name_unmatched_keys(spark):
    a = spark.createDataFrame([("k", 1.0), ("l", 2.0)], "key string, f2p double")
    b = spark.createDataFrame([("k", 0.0), ("m", 3.0)], "key string, f2p double")
    assert rows(joins.pair_arms_outer(a, b, ["key"])) == [
        ("k", 1.0, 0.0, "both"),
        ("l", 2.0, None, "treatment_only"),
        ("m", None, 3.0, "control_only"),
    ]


def test_breakdown_total_is_the_sum(spark, make_trials):
    trials = make_trials(
        [("a__r-1", 1, "fail", "pass", "fail"), ("b__r-2", 1, "fail", "fail", "pass"), ("b__r-2", 2, "fail", "pass", "fail")], control=True
    )
    tasks = rates.task_summary(trials).withColumn("owner", owner("task_id"))
    total = rates.breakdown(tasks, "owner", with_total=True)
    assert rows(total) == [
        (None, True, 2, pytest.approx(100 / 3), pytest.approx(200 / 3), 100.0),
        ("a", False, 1, 0.0, 100.0, 100.0),
        ("b", False, 1, 50.0, 50.0, 100.0),
    ]
    assert "control_f2p" not in rates.breakdown(rates.task_summary(trials, control=None), "task_id").columns


def test_union_and_keys(make_trials):
    trials = make_trials([("a", 1, "fail", "pass"), ("a", 1, "fail", "fail"), ("b", 1, "fail", "pass")])
    assert tables.union_shards([trials, trials]).count() == 6
    assert rows(tables.repeated_keys(trials)) == [("a", 1, 2)]
    assert rows(tables.one_per_key(trials)) == [("a", 1, "fail", "fail"), ("b", 1, "fail", "pass")]
    assert tables.sorted_trials(trials.drop("sample_index")).columns == ["task_id", "initial_state", "final_state"]


def test_repeats(make_trials):
    task = make_trials([("a", 0, "fail", "fail")]).select("task_id")
    assert rows(joins.expand_repeats(task, 3, 2)) == [("a", 2), ("a", 3)]
    assert rows(joins.expand_repeats(task, 1, 2)) == []
