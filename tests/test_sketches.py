"""Mergeable distinct counts against exact ones."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_plans import plan

from trialstats.operators.sketches import distinct_sketches, merged_sketches, overlap, sketched_counts


def made(spark, n=240_000):
    """Ids in two arms, a third of all rows in one group; ``few`` has fewer values than a sketch holds."""
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7))
    return spark.range(0, n, 1, 8).select(
        group.alias("g"), (F.col("id") % 4).alias("run"), F.concat(F.lit("t"), F.col("id") % 90_000).alias("task"), (F.col("id") % 1000).alias("few")
    )


def test_sketches_of_parts_give_those_of_the_whole(spark):
    data = made(spark)
    parts = distinct_sketches(data, ["g", "run"], ["task", "few"])
    for keys in (["g"], ["run"], []):
        got = {r[: len(keys)]: r for r in sketched_counts(merged_sketches(parts, keys, ["task", "few"]), keys, ["task", "few"]).collect()}
        exact = {r[: len(keys)]: r for r in data.groupBy(*keys).agg(F.count_distinct("task").alias("n_task"), F.count_distinct("few").alias("n_few")).collect()}
        assert got.keys() == exact.keys()
        for key, row in exact.items():
            assert got[key].n_few == row.n_few
            assert got[key].n_task == pytest.approx(row.n_task, rel=4 * 2**-6)


@pytest.mark.parametrize("precision", [8, 12, 16])
def test_error_falls_with_precision(spark, precision):
    counts = sketched_counts(distinct_sketches(made(spark), [], ["task"], precision), [], ["task"]).first()
    assert abs(counts.n_task - 90_000) <= 4 * 2 ** (-precision / 2) * 90_000


def test_overlap_of_arms(spark):
    left = made(spark).filter("task < 't5'")
    right = made(spark).filter("task >= 't3'")
    got = overlap(distinct_sketches(left, ["g"], ["task"]), distinct_sketches(right, ["g"], ["task"]), ["g"], "task", ("old", "new"))
    both = left.select("g", "task", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select("g", "task", F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = both.groupBy("g", "task").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    exact = {r.g: r for r in per.groupBy("g").agg(F.count_if((F.col("a") + F.col("b")) == 2).alias("c"), F.count_if(F.col("b") == 0).alias("o"), F.count_if(F.col("a") == 0).alias("n"), F.count("*").alias("e")).collect()}
    for r in got.collect():
        e = exact[r.g]
        for estimate, true in ((r.n_common, e.c), (r.n_only_old, e.o), (r.n_only_new, e.n), (r.n_either, e.e)):
            assert abs(estimate - true) <= 4 * 2**-6 * e.e


def test_sketches_of_odd_input(spark):
    odd = spark.createDataFrame([("a", "x"), ("a", None), ("a", ""), ("a", "x"), (None, "y"), ("b", None)], "g string, v string")
    assert rows(sketched_counts(distinct_sketches(odd, ["g"], ["v"]), ["g"], ["v"])) == [(None, 1), ("a", 1), ("b", 0)]
    none = odd.limit(0)
    assert rows(sketched_counts(distinct_sketches(none, ["g"], ["v"]), ["g"], ["v"])) == []
    assert rows(sketched_counts(distinct_sketches(none, [], ["v"]), [], ["v"])) == [(0,)]
    arms = overlap(distinct_sketches(odd, ["g"], ["v"]), distinct_sketches(odd.filter("g = 'a'").withColumn("v", F.lit("z")), ["g"], ["v"]), ["g"], "v")
    assert rows(arms) == [(None, 0, 1, 0, 1), ("a", 0, 1, 1, 2), ("b", 0, 0, 0, 0)]


def test_sketches_are_combined_before_one_shuffle(spark):
    text = plan(distinct_sketches(made(spark), ["g"], ["task"]))
    assert text.count("Arguments: hashpartitioning") == 1 and "partial_theta_sketch_agg" in text and "SortAggregate" not in text
