"""Published outcome shards, where a copy is at hand: set TRIAL_SHARDS to their glob, PILOT_SHARDS to the one-run ones."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from trialstats.functions.keys import OWNER_DOMAINS, owner, true_repo
from trialstats.operators import passk, rates
from trialstats.plans.comparison import domain_table, with_key
from trialstats.plans.quantiles import dispersion
from trialstats.sources.readers import read_shards

SHARDS, PILOT = os.environ.get("TRIAL_SHARDS"), os.environ.get("PILOT_SHARDS")
pytestmark = pytest.mark.skipif(not SHARDS, reason="TRIAL_SHARDS is not set")


@pytest.fixture(scope="module")
def trials(spark):
    # The control arm of the published figures is a random stream of another library; none is compared.
    return read_shards(spark, SHARDS).withColumn("base_state", F.lit("fail"))


def test_states(trials):
    assert dict(map(tuple, trials.groupBy("final_state").count().collect())) == {"pass": 1632, "fail": 3022, "INVALID": 2}
    bad = trials.filter("final_state = 'INVALID'").select("task_id", "sample_index").collect()
    assert {tuple(r) for r in bad} == {("martinrusev__imbox-97", 1), ("online-judge-tools__oj-903", 3)}


def test_run_rates(trials):
    by_run = rates.f2p_by_run(trials)
    assert [r.f2p for r in by_run.orderBy("sample_index").collect()] == pytest.approx([34.858247, 36.275773, 34.020619])
    row = dispersion(by_run, "f2p").first()
    assert [row.mean, row.sd, row.p25, row.median, row.p75] == pytest.approx(
        [35.051546, 0.930754, 34.439433, 34.858247, 35.567010], rel=1e-6
    )


def test_pass_at_k(trials):
    curve = passk.pass_at_k(trials, [1, 2, 3]).orderBy("k").collect()
    assert [r.pass_at_k for r in curve][1:] == pytest.approx([58.440722, 71.585052])
    solved = passk.solved_tasks(trials).select((F.col("solved").cast("int") * 100.0).alias("x"))
    assert dispersion(solved, "x").first().sd == pytest.approx(45.100838)


def test_keys(trials):
    compat = rates.paired_rates(with_key(trials, "compat"), ["pair_key", "sample_index"])
    assert compat.count() == 1311
    assert trials.select(owner("task_id")).distinct().count() == 437
    assert trials.select(true_repo("task_id")).distinct().count() == 482
    row = dispersion(compat, "f2p_treatment").first()
    assert [row.p25, row.median, row.p75, row.mean] == pytest.approx([0, 100 / 3, 50, 34.765097], rel=1e-6)


def test_domains(spark, trials):
    lookup = spark.createDataFrame(list(OWNER_DOMAINS.items()), "owner string, domain string")
    table = {r.domain: (r.tasks, round(r.pass1_f2p, 2), round(r.passk_rate, 2)) for r in domain_table(trials, lookup).collect()}
    assert table == {
        "General Software Utilities": (1281, 35.05, 71.82),
        "Database & Query Engines": (47, 34.04, 72.34),
        "Infrastructure & Monitoring": (47, 34.04, 68.09),
        "Web & Media Systems": (42, 36.51, 69.05),
        "Data Science & Machine Learning": (38, 32.46, 60.53),
        "Code Quality & Linters": (30, 34.44, 66.67),
        "Web Frameworks": (20, 33.33, 75.0),
        "CLI & Text Parsing": (17, 41.18, 76.47),
        "Developer CLI Tools": (17, 41.18, 94.12),
        "Embedded Systems & Hardware": (13, 33.33, 69.23),
    }


@pytest.mark.skipif(not PILOT, reason="PILOT_SHARDS is not set")
def test_one_run_shards(spark):
    row = rates.funnel(passk.first_outcomes(read_shards(spark, PILOT))).first()
    assert (row.n_rows, row.n_tasks, row.n_rescued, row.n_invalid) == (1552, 1552, 498, 1)
    assert row.f2p == pytest.approx(32.0876, rel=1e-5)
