"""Paired statistics against brute force, under ties, skew and other partitionings."""

from __future__ import annotations

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import views
from trialstats.operators import rates
from trialstats.plans.comparison import summary_report, summary_row, with_key
from trialstats.functions.hashing import uniform
from trialstats.plans import exact_tail
from trialstats.plans import quantiles as quantiles_module
from trialstats.plans.paired import cliffs_delta, exact_upper_tail, normal_upper_tail, paired_comparison, signed_ranks
from trialstats.plans.quantiles import box_plot, dispersion, histogram, quantiles, value_counts
from trialstats.plans.running import attach_to_groups, running_totals
from trialstats.session import stored_table


def brute(pairs):
    """Statistics of a list of (treatment, control), straight from the definitions."""
    d = np.array([t - c for t, c in pairs], dtype=float)
    d = d[d != 0]
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    n, w = len(d), float(ranks[d > 0].sum())
    sizes = pd.Series(np.abs(d)).value_counts().to_numpy(dtype=float)
    variance = n * (n + 1) * (2 * n + 1) / 24 - (sizes**3 - sizes).sum() / 48
    t, c = (np.array(x, dtype=float) for x in zip(*pairs))
    signs = np.sign(t[:, None] - c[None, :]).sum()
    return {
        "n_pairs": len(pairs),
        "n_nonzero": n,
        "w_plus": w,
        "w_minus": float(ranks[d < 0].sum()),
        "z": (w - n * (n + 1) / 4) / math.sqrt(variance) if n else None,
        "sign_sum": signs,
        "cliffs_delta": signs / len(pairs) ** 2,
        "ranks": ranks,
    }


def brute_p(ranks, w):
    sums = [sum(r for r, up in zip(ranks, mask) if up) for mask in itertools.product([0, 1], repeat=len(ranks))]
    return sum(s >= w for s in sums) / len(sums)


def compare(spark, pairs, **options):
    df = spark.createDataFrame([(float(t), float(c)) for t, c in pairs], "f2p_treatment double, f2p_control double")
    return paired_comparison(df, **options).first()


def check(row, expected):
    for name in ("n_pairs", "n_nonzero", "w_plus", "w_minus", "z", "cliffs_delta"):
        got = getattr(row, name)
        assert got == (None if expected[name] is None else pytest.approx(expected[name])), name
    assert int(row.sign_sum) == expected["sign_sum"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12))
def test_against_definitions(spark, pairs):
    row, expected = compare(spark, pairs), brute(pairs)
    check(row, expected)
    assert row.p_value == pytest.approx(brute_p(expected["ranks"], expected["w_plus"]) if expected["n_nonzero"] else 1.0)


def test_swapped_arms_share_the_ranks(spark):
    pairs = [(i * 7 % 11, i * 5 % 13) for i in range(60)]
    a, b = compare(spark, pairs), compare(spark, [(c, t) for t, c in pairs])
    assert a.w_plus + b.w_plus == a.n_nonzero * (a.n_nonzero + 1) / 2
    assert (a.w_plus, a.cliffs_delta) == (b.w_minus, -b.cliffs_delta)


def test_all_zero_differences(spark):
    row = compare(spark, [(1, 1), (2, 2)])
    assert (row.n_pairs, row.n_nonzero, row.w_plus, row.p_value, row.z) == (2, 0, 0.0, 1.0, None)


@pytest.mark.parametrize("n, w, p", [(6, 20, 0.03125), (3, 5, 0.25), (2, 3, 0.25), (11, 54, 0.03369140625)])
def test_exact_tails(spark, n, w, p):
    ranks = f"sequence(2, {2 * n}, 2)"
    assert spark.range(1).select(exact_upper_tail(ranks, str(2 * w)).alias("p")).first().p == p


def counted_tail(ranks, w2):
    """The share of all choices of signs whose positive doubled ranks reach ``w2``, in whole numbers."""
    ways = np.zeros(sum(ranks) + 1, dtype=object)
    ways[0] = 1
    for r in ranks:
        ways[r:] = ways[r:] + ways[:-r].copy()
    return Fraction(int(sum(ways[w2:].tolist())), 2 ** len(ranks))


def doubled_ranks(sizes):
    """(doubled rank, pairs, pairs before) of differences that are tied in groups of these sizes."""
    befores = [sum(sizes[:i]) for i in range(len(sizes))]
    return [(2 * b + m + 1, m, b) for m, b in zip(sizes, befores)]


def test_product_tree_equals_enumeration(spark):
    """Groups of all sizes up to 13 pairs and some larger ones, tied or not, at sums from none to all; small rows, so the tree is deep."""
    rng = random.Random(7)
    groups = {}
    for n in [*range(1, 14), 60, 110]:
        sizes = []
        while sum(sizes) < n:
            sizes.append(min(rng.choice([1, 1, 1, 2, 5]), n - sum(sizes)))
        ranks = doubled_ranks(sizes)
        whole = n * (n + 1)
        for w2 in {0, 1, whole // 2, whole * 3 // 4, whole - 2, whole}:
            groups[len(groups)] = (ranks, w2)
    names = {g: None if g == 3 else g for g in groups}
    rows_ = [(names[g], *r) for g, (ranks, _) in groups.items() for r in ranks]
    sums = spark.createDataFrame([(names[g], w2) for g, (_, w2) in groups.items()], "g int, w2 bigint")
    got = {r.g: r.p_exact for r in exact_tail.exact_tails(spark.createDataFrame(rows_, "g int, r int, m int, before int"), sums, ["g"], block=256, leaf_size=3000).collect()}
    assert len(got) == len(groups)
    for g, (ranks, w2) in groups.items():
        wanted = counted_tail([r for r, m, _ in ranks for _ in range(m)], w2)
        assert got[names[g]] == pytest.approx(float(wanted), rel=1e-9)


def test_product_tree_of_many_pairs(spark):
    """Far tails keep their digits: 400 pairs, the largest sum has the chance 2 ** -400."""
    n = 400
    ranks = spark.createDataFrame([(k, 2 * (i + 1), 1, i) for k in range(3) for i in range(n)], "k int, r int, m int, before int")
    w2 = {0: n * (n + 1), 1: n * (n + 1) * 9 // 10, 2: 0}
    got = {r.k: r.p_exact for r in exact_tail.exact_tails(ranks, spark.createDataFrame(list(w2.items()), "k int, w2 bigint"), ["k"]).collect()}
    assert got[0] == pytest.approx(2.0**-n, rel=1e-9) and got[2] == pytest.approx(1.0)
    assert got[1] == pytest.approx(float(counted_tail(list(range(2, 2 * n + 1, 2)), w2[1])), rel=1e-9)


def test_no_ranks_no_tails(spark):
    none = spark.createDataFrame([], "k int, r int, m int, before int")
    assert exact_tail.exact_tails(none, spark.createDataFrame([], "k int, w2 bigint"), ["k"]).collect() == []


def test_exact_tail_of_fifty(spark):
    ranks = "sequence(2, 100, 2)"
    whole = spark.range(1).select(
        exact_upper_tail(ranks, "0").alias("all"), exact_upper_tail(ranks, "1276").alias("upper")
    ).first()
    assert whole.all == 1.0
    assert whole.upper == 0.5  # the ranks add up to an odd number, so half of the choices reach more than half of it


def test_normal_tail(spark):
    zs = [z / 4 for z in range(-40, 150)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_upper_tail("z").alias("p")).collect()
    for row in got:
        assert row.p == pytest.approx(0.5 * math.erfc(row.z / math.sqrt(2)), rel=1e-11)


def rank_all(values):
    return [sum(y < x for y in values) + (sum(y == x for y in values) + 1) / 2 for x in values]


def test_methods(spark):
    pairs = [(i % 17, i * 3 % 7) for i in range(80)]
    row, expected = compare(spark, pairs), brute(pairs)
    assert row.p_value == pytest.approx(0.5 * math.erfc(expected["z"] / math.sqrt(2)))
    assert row.p_method == "asymptotic"
    exact = compare(spark, pairs, method="exact")
    ways, ranks2 = {0: 1}, [round(2 * r) for r in rank_all([abs(a - b) for a, b in pairs if a != b])]
    for r in ranks2:
        shifted = dict(ways)
        for total, n in ways.items():
            shifted[total + r] = shifted.get(total + r, 0) + n
        ways = shifted
    reached = sum(n for total, n in ways.items() if total >= round(2 * expected["w_plus"]))
    assert exact.n_nonzero > 60 and exact.p_method == "exact"
    assert exact.p_value == pytest.approx(reached / 2 ** len(ranks2), rel=1e-9)
    assert compare(spark, pairs[:9], method="asymptotic").p_value == pytest.approx(
        0.5 * math.erfc(brute(pairs[:9])["z"] / math.sqrt(2))
    )
    with pytest.raises(ValueError):
        compare(spark, pairs, method="guess")


def skewed(spark, n=3000):
    """Groups of which one holds half of the rows, a null group, and repeated values."""
    group = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 7))
    return spark.range(n).select(
        group.alias("g"),
        (F.xxhash64("id", F.lit(1)) % 400 / 10.0).alias("f2p_treatment"),
        (F.xxhash64("id", F.lit(2)) % 300 / 10.0).alias("f2p_control"),
    )


@pytest.mark.parametrize("chunks", ["1", "3", "16"])
def test_groups_under_skew_and_partitioning(spark, chunks):
    data = skewed(spark)
    spark.conf.set("spark.sql.shuffle.partitions", chunks)
    try:
        got = {r.g: r for r in paired_comparison(data, group_cols=["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    local = data.toPandas()
    groups = dict(list(local.groupby("g"))) | {None: local[local.g.isna()]}
    assert set(got) == set(groups)
    for name, part in groups.items():
        check(got[name], brute(list(zip(part.f2p_treatment, part.f2p_control))))


def test_tie_rounding(spark):
    pairs = [(0.1 + 0.2, 0.0), (0.3, 0.0), (0.0, 1.0)]
    assert compare(spark, pairs).w_plus == 3.0
    df = spark.createDataFrame(pairs, "f2p_treatment double, f2p_control double")
    assert rows(signed_ranks(df).select("avg_rank")) == [(1.0,), (2.0,), (3.0,)]
    assert rows(signed_ranks(df, tie_decimals=9).select("avg_rank")) == [(1.5,), (3.0,)]


def test_unpaired_delta(spark):
    a, b = [i * 7 % 23 for i in range(40)], [i * 5 % 19 for i in range(25)]
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("c", 1.0)], "arm string, v double")
    row = cliffs_delta(df, "v", "arm", "a", "b").first()
    signs = np.sign(np.array(a)[:, None] - np.array(b)[None, :])
    assert (row.n_treatment, row.n_control) == (40, 25)
    assert (int(row.wins), int(row.losses), int(row.ties)) == ((signs > 0).sum(), (signs < 0).sum(), (signs == 0).sum())
    assert row.cliffs_delta == pytest.approx(signs.mean())


def test_counted_figures_of_the_test_tables(spark, small):
    """Three runs, counted beforehand. W+ rests on float ties, so on the order of the rate arithmetic.

    308992.0 is the figure counted with ``100 * passes / n``. The rate here is ``passes / n * 100``, the
    order of the studied scripts, whose ties give 309220.5; rounded to nine places both give 309082.0.
    """
    trials = views.trials(spark, small).filter("sample_index <= 3")
    # The second arm that the figures were counted with: a seeded draw from order and line.
    drawn = uniform(["_order", "sample_index"]) < 0.1606
    trials = trials.withColumn("_order", F.regexp_extract("task_id", "([0-9]+)$", 1))
    trials = trials.withColumn("base_state", F.when(drawn, "pass").otherwise("fail")).drop("_order")
    keyed, keys = with_key(trials, "owner"), ["pair_key", "sample_index"]
    pairs = rates.paired_rates(keyed, keys)
    row = paired_comparison(pairs).first()
    assert (row.n_pairs, row.n_nonzero, row.w_plus, int(row.sign_sum)) == (1200, 976, 309220.5, 289504)
    assert row.cliffs_delta == pytest.approx(289504 / 1440000)
    assert paired_comparison(pairs, tie_decimals=9).first().w_plus == 309082.0

    counted = rates.group_known(keyed, keys, rates.paired_counts()).toPandas()
    local = [counted[c] / counted.n_failing * 100 for c in ("n_rescued", "n_control")]
    assert brute(list(zip(*local)))["w_plus"] == 309220.5
    other = [100 * counted[c] / counted.n_failing for c in ("n_rescued", "n_control")]
    row = compare(spark, list(zip(*other)))
    assert (row.w_plus, int(row.sign_sum)) == (308992.0, 289504)


def test_summary(spark, tiny):
    trials = views.trials(spark, tiny)
    row = summary_row(trials, "owner")
    report = dict(rows(summary_report(row)))
    values = row.first()
    assert report["Agentic_F2P_Avg_Pass@1"] == f"{values.treatment_f2p:.2f}%"
    assert report["p-value"] == f"{values.p_value:.6f}"
    assert values.p_value == pytest.approx(0.5 * math.erfc(values.z / math.sqrt(2)))
    assert report["Reject_H0"] == ("Yes" if values.p_value < 0.05 and values.treatment_f2p > 16.06 else "No")


def test_running_totals(spark):
    counted = value_counts(skewed(spark), "f2p_treatment", ["g"])
    got = running_totals(counted, ["g"], "f2p_treatment", ["n"]).toPandas()
    got["g"] = got.g.fillna("null")
    got = got.sort_values(["g", "f2p_treatment"])
    assert (got.n_before == got.groupby("g").n.cumsum() - got.n).all()
    assert (got.n_total == got.groupby("g").n.transform("sum")).all()
    assert got.n.sum() == 3000


@pytest.mark.parametrize("chunks", [1, 2, 7, 400])
def test_running_totals_over_ranges(spark, chunks):
    """Groups that span many ranges, several groups in one, null and NaN groups, null sums, more ranges than rows."""
    made = spark.range(900).select(
        F.when(F.col("id") < 600, 1.5).when(F.col("id") < 700, float("nan")).when(F.col("id") >= 720, F.col("id").cast("double")).alias("g"),
        F.when(F.col("id") % 2 == 0, "x").alias("h"),
        F.col("id").cast("string").alias("v"),
        F.when(F.col("id") % 10 != 0, F.col("id") % 13).alias("n"),
        (F.col("id") % 3).cast("int").alias("m"),
    )
    got = running_totals(made, ["g", "h"], "v", ["n", "m"], chunks)
    inside = Window.partitionBy("g", "h")
    before = inside.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    expected = made.select(
        "*",
        *[F.coalesce(F.sum(c).over(before), zero).alias(f"{c}_before") for c in ("n", "m")],
        *[F.coalesce(F.sum(c).over(inside), zero).alias(f"{c}_total") for c in ("n", "m")],
    )
    shown = [F.col("g").cast("string"), *expected.columns[1:]]  # NaN is not equal to itself in Python
    assert rows(got.select(shown)) == rows(expected.select(shown))
    assert rows(running_totals(made.limit(0), ["g", "h"], "v", ["n"], chunks)) == []
    alone = running_totals(made, [], "v", ["m"], chunks).toPandas().sort_values("v")
    assert (alone.m_before == alone.m.cumsum() - alone.m).all() and (alone.m_total == alone.m.sum()).all()


def test_quantiles_as_numpy(spark):
    data = skewed(spark)
    got = {r.g: r for r in dispersion(data, "f2p_treatment", ["g"]).collect()}
    local = data.toPandas()
    for name, row in got.items():
        v = local[local.g.isna() if name is None else local.g == name].f2p_treatment
        expected = [len(v), v.mean(), np.percentile(v, 50), v.std(ddof=0), *np.percentile(v, [25, 75]), v.min(), v.max()]
        assert list(row[1:]) == pytest.approx(expected)
    tails = quantiles(data, "f2p_treatment", [0.01, 0.999], ["low", "high"]).first()
    assert [tails.low, tails.high] == pytest.approx(list(np.percentile(local.f2p_treatment, [1, 99.9])))


@pytest.mark.parametrize("sketch, grid, margin, listed", [(16, 400, 0.01, 100_000), (256, 400, 0.02, 40), (256, 50, 0.001, 5), (4096, 400, 0.01, 30)])
def test_brackets_are_exact_whatever_the_sketch(spark, monkeypatch, sketch, grid, margin, listed):
    """Small sketches that miss, brackets that must be narrowed again and again, ties, and single values: the same quantiles."""
    for name, size in (("SKETCH", sketch), ("GRID", grid), ("MARGIN", margin), ("LISTED", listed)):
        monkeypatch.setattr(quantiles_module, name, size)
    made = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"),
        F.when(F.col("id") % 3 == 0, (F.xxhash64("id") % 10_000).cast("double")).when(F.col("id") % 3 == 1, 7.5).otherwise((F.xxhash64("id") % 5).cast("double")).alias("v"),
    )
    extra = spark.createDataFrame([("c", 1.0), ("c", None), ("d", None), ("e", float("nan")), ("c", 4.0)], "g string, v double")
    data = made.unionByName(extra)
    got = {r.g: r for r in dispersion(data, "v", ["g"]).collect()}
    local = data.toPandas().dropna(subset=["v"])
    assert set(got) == {"a", "b", "c", None}
    for name, row in got.items():
        v = local[local.g.isna() if name is None else local.g == name].v
        assert list(row[1:]) == pytest.approx([len(v), v.mean(), np.percentile(v, 50), v.std(ddof=0), *np.percentile(v, [25, 75]), v.min(), v.max()])
    assert dispersion(data.limit(0), "v", ["g"]).collect() == [] == dispersion(data.limit(0), "v").collect()


def test_no_range_shuffle_and_no_table_of_rows(spark, monkeypatch):
    """What is written is a row for each group and position, and the rows are only ever combined."""
    written = []

    def seen(df):
        out = stored_table(df)
        written.append(out.count())
        assert "rangepartitioning" not in df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(quantiles_module, "stored_table", seen)
    dispersion(skewed(spark, 20_000), "f2p_treatment", ["g"]).collect()
    assert max(written) <= 3 * 10


def test_groups_take_the_salted_join(spark):
    rows_ = skewed(spark).select("g", F.col("f2p_treatment").alias("_v"))
    per_group = rows_.groupBy("g").agg(F.max("_v").alias("top"))
    assert "_salt" in attach_to_groups(rows_, per_group, ["g"], "_v")._jdf.queryExecution().executedPlan().toString()


def test_box_plot(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 5, 100]], "arm string, v double")
    assert rows(box_plot(df, "v", "arm")) == [("a", 2.25, 3.5, 4.75, 1.0, 5.0, 1)]


def test_histogram_as_numpy(spark):
    values = [float(x * x % 101) for x in range(300)]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    got = histogram(df, "v", 10).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert [r.n for r in got] == list(counts)
    assert [r.bin_low for r in got] == pytest.approx(list(edges[:-1]))
    flat = histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 5).orderBy("bin").collect()
    assert [r.n for r in flat] == list(np.histogram([3.0, 3.0], bins=5)[0])


def test_one_population_in_a_report(spark, make_trials):
    """Ids of another form share a key under ``repo``; pairs and rates of runs cover the same trials."""
    ids = ["a__b-1", "plain", "other_form", "c__d"]
    trials = make_trials([(t, 1, "fail", "pass" if t == "a__b-1" else "fail", "fail") for t in ids], control=True)
    assert {r.pair_key for r in with_key(trials, "repo").collect()} == {"a/b", "mock_owner/mock_project"}
    row = summary_row(trials, "repo").first()
    assert row.n_pairs == 2 and row.mean_treatment == 50.0 and row.treatment_f2p == 25.0
