"""Physical plans: what is pushed down, what is reused, and what happens to a hot key."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from checks import views
from trialstats.operators import joins, passk, rates, sampling
from trialstats.plans.comparison import compare_arms, with_key
from trialstats.plans import running
from trialstats.plans.paired import paired_comparison
from trialstats.session import _STORED, removing_stored, stored_table


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def run_plan(df) -> str:
    """The plan as adapted while it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_only_needed_columns_are_read(spark, tiny):
    text = plan(rates.f2p_by_run(views.trials(spark, tiny)))
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_returnflag:string>" in text


def test_filters_reach_the_scan(spark, tiny, tmp_path):
    views.trials(spark, tiny).write.parquet(f"{tmp_path}/trials")
    trials = spark.read.parquet(f"{tmp_path}/trials")
    text = plan(rates.f2p(trials.filter("sample_index = 2 AND initial_state = 'fail'"), ["task_id"]))
    assert "EqualTo(sample_index,2)" in text and "EqualTo(initial_state,fail)" in text
    assert "base_state" not in text.split("ReadSchema")[1].splitlines()[0]


def test_rates_are_one_shuffle_with_partial_counts(spark, tiny):
    text = plan(rates.paired_rates(with_key(views.trials(spark, tiny), "owner"), ["pair_key", "sample_index"]))
    assert text.count("Arguments: hashpartitioning") == 1
    assert "partial_count" in text


@pytest.mark.parametrize("key", ["owner", "repo"])
def test_a_computed_key_is_computed_once(spark, tiny, key):
    trials = spark.createDataFrame([("a__b-1", 1, "fail", "pass", "fail")], "task_id string, sample_index int, initial_state string, final_state string, base_state string")
    text = plan(rates.paired_rates(with_key(trials, key), ["pair_key", "sample_index"]))
    assert text.count("+- Filter") == 1
    condition = next(line for line in text.splitlines() if line.startswith("Condition"))
    assert "> 0" in condition and "task_id" not in condition and "pair_key" not in condition


@pytest.mark.parametrize(
    "build",
    [
        lambda t: compare_arms(t, "owner"),
        lambda t: passk.pass_at_k(t, [1, 2, 3]),
        lambda t: rates.shares(rates.task_outcomes(rates.task_summary(t)), "outcome"),
        lambda t: sampling.sample_ids(t, "task_id", 0.1),
        lambda t: sampling.round_robin_shards(t, "task_id", 4),
    ],
)
def test_no_cross_joins(spark, tiny, build):
    text = run_plan(build(views.trials(spark, tiny)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_counts_behind_shares_are_made_once(spark, tiny):
    shares = rates.shares(views.trials(spark, tiny), "final_state")
    assert "ReusedExchange" in run_plan(shares)


def test_first_repeats_are_cut_before_the_shuffle(spark, tiny):
    text = plan(passk.first_k_repeats(views.trials(spark, tiny), 2))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def hot_trials(spark, n=60000):
    """A third of all rows belong to one task."""
    task = F.when(F.col("id") % 3 == 0, "hot__r-1").otherwise(F.concat(F.lit("o"), F.col("id") % 900, F.lit("__r-"), F.col("id")))
    return spark.range(0, n, 1, 8).select(
        task.alias("task_id"), (F.col("id") % 5 + 1).cast("int").alias("sample_index"), F.lit("fail").alias("initial_state"),
        F.when(F.xxhash64("id") % 3 == 0, "pass").otherwise("fail").alias("final_state"),
        F.sha2(F.col("id").cast("string"), 512).alias("note"),
    )


SPLIT_SMALL = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "100KB",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "100KB",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
    "spark__sql__shuffle__partitions": "32",
}


def test_hot_keys_of_lookups_are_split(spark):
    trials = hot_trials(spark)
    lookup = trials.groupBy(F.col("task_id").alias("instance_id")).agg(F.lit("o/r").alias("repo"))
    with settings(spark, **SPLIT_SMALL):
        found = joins.attach_repo(trials, lookup)
        assert "SortMergeJoin(skew=true)" in run_plan(found)
        assert found.filter("repo = 'o/r'").count() == 60000
        kept = joins.keep_ids(trials, sampling.sample_ids(trials, "task_id", 1.0), "task_id")
        assert "SortMergeJoin(skew=true)" in run_plan(kept)
        assert kept.count() == 60000


def test_hot_task_in_rates(spark):
    trials = hot_trials(spark)
    row = passk.pass_at_all(trials).first()
    assert row.n_tasks == 40001
    by_task = rates.f2p(trials, ["task_id"])
    assert by_task.filter("task_id = 'hot__r-1'").first().n_failing == 20000


def test_one_value_in_most_pairs(spark):
    """Half of all pairs differ by the same amount: they become one histogram row before the shuffle."""
    pairs = spark.range(40000).select(
        F.when(F.col("id") % 2 == 0, 1.0).otherwise((F.col("id") % 997).cast("double")).alias("f2p_treatment"),
        F.when(F.col("id") % 2 == 0, 0.0).otherwise((F.col("id") % 499).cast("double")).alias("f2p_control"),
    )
    row = paired_comparison(pairs).first()
    local = pairs.toPandas()
    d = local.f2p_treatment - local.f2p_control
    d = d[d != 0]
    assert row.n_pairs == 40000
    assert row.w_plus == d.abs().rank()[d > 0].sum()


def test_running_totals_shuffle_nothing_after_the_ranges(spark, tiny):
    """What is read after the ranges is their rows and the few carried totals, which are small enough to be sent."""
    prices = views.table(spark, tiny, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count("*").alias("n"))
    with removing_stored(spark):
        text = run_plan(running.running_totals(prices, ["l_returnflag"], "l_extendedprice", ["n"], 12))
    assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text and "Window" not in text
    assert text.count("BroadcastExchange") >= 1


def test_ranges_follow_from_counted_rows(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE_ROWS", 100)
    made = spark.range(2000).select(F.lit(1).alias("g"), F.col("id").alias("v"), F.lit(1).alias("n"))
    with removing_stored(spark):
        sizes = [r["count"] for r in running.stored_in_ranges(made, ["g"], "v", ["n"]).groupBy(running.CHUNK).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 400


def test_stored_tables_are_removed_by_their_owner(spark):
    before = list(_STORED)
    with removing_stored(spark):
        held = stored_table(spark.range(5))
        assert held.count() == 5 and len(_STORED) == len(before) + 1
        path = _STORED[-1]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert before == _STORED and not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
