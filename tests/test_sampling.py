"""Samples, shards and control arms: exact sizes, seeds, and no dependence on the partitioning."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trialstats.functions.hashing import hash_shard, uniform
from trialstats.operators import sampling


@pytest.fixture(scope="module")
def ids(spark):
    """1,237 ids, one of them in a third of the rows, and a null."""
    name = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 1900))
    return spark.range(3000).select(F.when(F.col("id") != 7, name).alias("task"), (F.col("id") % 4).alias("kind"))


def distinct(ids):
    return sorted({r.task for r in ids.collect()} - {None})


def by_hash(names, seed):
    return sorted(names, key=lambda n: hashlib.md5(f"{seed}|{n}".encode()).hexdigest())


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.5, 1.0])
@pytest.mark.parametrize("step, ranked", [(1, 3), (3, 10_000)])
def test_fraction_of_ids(ids, fraction, step, ranked, monkeypatch):
    monkeypatch.setattr(sampling, "STEP", step)
    monkeypatch.setattr(sampling, "RANKED", ranked)
    names = distinct(ids)
    wanted = by_hash(names, 42)[: round(len(names) * fraction)]
    assert [r[0] for r in rows(sampling.sample_ids(ids, "task", fraction))] == sorted(wanted)


def test_all_rows_of_the_sampled_ids(ids):
    chosen = set(by_hash(distinct(ids), 1)[: round(len(distinct(ids)) * 0.3)])
    expected = ids.filter(F.col("task").isin(list(chosen))).count()
    assert sampling.sample_fraction(ids, "task", 0.3, seed=1).count() == expected


def test_n_ids_and_no_op(ids):
    unique = ids.select("task").distinct().filter("task IS NOT NULL")
    assert sampling.sample_n(unique, "task", 17).count() == 17
    assert sampling.sample_n(unique, "task", 10**6).count() == unique.count()


def test_strata(ids):
    got = sampling.sample_strata(ids, "task", "kind", 0.1).groupBy("kind").count()
    sizes = ids.filter("task IS NOT NULL").groupBy("kind").agg(F.count_distinct("task").alias("n"))
    assert dict(rows(got)) == {k: math.ceil(n * 0.1) for k, n in rows(sizes)}


def test_null_stratum_is_kept(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "task string, kind string")
    assert sampling.sample_strata(df, "task", "kind", 0.5).count() == 2


def test_samples_do_not_depend_on_partitions(ids):
    def once(n):
        return rows(sampling.sample_ids(ids.repartition(n), "task", 0.2, seed="s"))

    assert once(1) == once(13)


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_round_robin(ids, shards):
    got = dict(rows(sampling.round_robin_shards(ids, "task", shards)))
    assert got == {name: i % shards for i, name in enumerate(distinct(ids))}


def test_hash_shards(ids):
    got = {r.task: r.s for r in ids.filter("task IS NOT NULL").select("task", hash_shard("task", 8).alias("s")).collect()}
    assert got == {n: int(hashlib.md5(n.encode()).hexdigest()[:8], 16) % 8 for n in got}


def test_uniform(spark):
    df = spark.range(20000).withColumn("run", F.col("id") % 3)
    share = df.agg(F.avg((uniform(["id", "run"]) < 0.1606).cast("int"))).first()[0]
    assert share == pytest.approx(0.1606, abs=0.01)
    u = df.limit(1).select(uniform(["id", "run"], 9).alias("u"), "id", "run").first()
    assert u.u == int(hashlib.md5(f"9|{u.id}|{u.run}".encode()).hexdigest()[:8], 16) / 2**32


@pytest.mark.parametrize("ranked", [2, 10_000])
def test_exactly_n_rows(spark, monkeypatch, ranked):
    """Repeated and null ids, rows that are alike, and every n from none to all and beyond; each sample holds the smaller ones."""
    monkeypatch.setattr(sampling, "RANKED", ranked)
    made = [("a", 1), ("a", 2), ("a", 2), (None, 3), (None, 3), (None, 4), ("", 5), ("b", 6)] + [("hot", 7)] * 30
    df = spark.createDataFrame(made, "task string, v int").repartition(4)
    before = Counter()
    for n in (0, 1, 2, 5, 9, 20, 33, 38, 50):
        got = Counter(rows(sampling.sample_n(df, "task", n)))
        assert sum(got.values()) == min(n, len(made))
        assert not got - Counter(made) and not before - got
        before = got


def test_hot_stratum_is_split(spark, monkeypatch):
    """A stratum with nearly all ids is counted and taken by salted keys, and only its end is ranked."""
    monkeypatch.setattr(sampling, "RANKED", 20)
    df = spark.range(4000).select(F.concat(F.lit("t"), F.col("id")).alias("task"), F.when(F.col("id") % 100 == 0, None).otherwise("hot").alias("kind"))
    got = sampling.sample_strata(df, "task", "kind", 0.25)
    assert rows(got.groupBy("kind").count()) == [(None, 10), ("hot", 990)]
    assert "_salt" in got._jdf.queryExecution().executedPlan().toString()
