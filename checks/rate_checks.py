"""Predicates, joins, rates, Pass@k and dispersion."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from trialstats.functions.keys import owner, true_repo
from trialstats.functions.states import initially_failing, is_invalid, succeeded
from trialstats.operators import joins, passk, rates, sketches, tables
from trialstats.operators.rates import RUN
from trialstats.plans import quantiles
from trialstats.plans.comparison import domain_table, with_key
from trialstats.schema import TRIAL_SCHEMA

T = v.TRIALS
TRIAL_COLUMNS = TRIAL_SCHEMA.fieldNames()


# --- predicates -----------------------------------------------------------------------------------


@check("p1_initially_failing", v.with_views("SELECT task_id, sample_index, final_state FROM trials WHERE initial_state = 'fail'", T))
def p1(spark, sf):
    return v.trials(spark, sf).filter(initially_failing()).select("task_id", "sample_index", "final_state")


@check("p2_success_flag", v.with_views("SELECT task_id, sample_index, final_state = 'pass' AS success FROM trials", T))
def p2(spark, sf):
    return v.trials(spark, sf).select("task_id", "sample_index", succeeded().alias("success"))


@check("p3_one_run", v.with_views("SELECT task_id, initial_state, final_state FROM trials WHERE sample_index = 2", T))
def p3(spark, sf):
    return v.trials(spark, sf).filter(F.col("sample_index") == 2).select("task_id", "initial_state", "final_state")


@check(
    "p4_one_domain",
    v.with_views(
        f"SELECT task_id, sample_index, final_state FROM trials JOIN domains ON {v.OWNER} = owner WHERE domain = 'NATION_6'",
        T,
        v.DOMAINS,
    ),
)
def p4(spark, sf):
    chosen = v.domains(spark, sf).filter("domain = 'NATION_6'")
    return joins.keep_ids(v.trials(spark, sf).withColumn("owner", owner("task_id")), chosen, "owner").select(
        "task_id", "sample_index", "final_state"
    )


@check("p5_nonzero_differences", v.with_views("SELECT owner, sample_index, round(t - c, 6) AS diff FROM pairs WHERE t - c <> 0", T, v.PAIRS))
def p5(spark, sf):
    pairs = rates.paired_rates(with_key(v.trials(spark, sf), "owner", "owner"), ["owner", "sample_index"])
    diff = F.col("f2p_treatment") - F.col("f2p_control")
    return pairs.withColumn("diff", diff).filter("diff <> 0").select("owner", "sample_index", "diff")


@check("p6_invalid_trials", v.with_views("SELECT task_id, sample_index FROM trials WHERE final_state = 'INVALID'", T))
def p6(spark, sf):
    return v.trials(spark, sf).filter(is_invalid()).select("task_id", "sample_index")


@check("p7_derived_columns", v.with_views(f"SELECT task_id, sample_index, {v.OWNER} AS owner, {v.REPO} AS repo FROM trials", T))
def p7(spark, sf):
    return (
        v.trials(spark, sf)
        .withColumn("owner", owner("task_id"))
        .withColumn("repo", true_repo("task_id"))
        .select("task_id", "sample_index", "owner", "repo")
    )


# --- joins ----------------------------------------------------------------------------------------

COMPAT = (
    "CASE WHEN len(string_split(task_id, '_')) > 1 AND NOT regexp_full_match(string_split(task_id, '_')[-1], '[0-9]+') "
    "THEN string_split(task_id, '_')[1] || '/' || string_split(task_id, '_')[2] ELSE 'mock_owner/mock_project' END"
)


@check(
    "j1_repo_lookup",
    v.with_views(
        f"SELECT task_id, sample_index, coalesce(k.repo, {COMPAT}) AS repo FROM trials "
        "LEFT JOIN (SELECT instance_id, repo FROM tasks WHERE released) k ON task_id = instance_id",
        T,
        v.TASKS,
    ),
)
def j1(spark, sf):
    return joins.attach_repo(v.trials(spark, sf), v.repo_lookup(spark, sf)).select("task_id", "sample_index", "repo")


@check(
    "j1_latest_entry",
    """SELECT l_orderkey AS task, max(supplier) AS supplier FROM (
         SELECT l_orderkey, l_suppkey AS supplier, rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC) AS r
         FROM lineitem) WHERE r = 1 GROUP BY l_orderkey""",
)
def j1_latest(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("supplier"), "l_shipdate"
    )
    return joins.latest(lines, "task", "supplier", "l_shipdate")


@check(
    "j2_domain_lookup",
    v.with_views(
        f"SELECT task_id, sample_index, coalesce(domain, '{v.DEFAULT_DOMAIN}') AS domain FROM trials LEFT JOIN domains ON {v.OWNER} = owner",
        T,
        v.DOMAINS,
    ),
)
def j2(spark, sf):
    owned = v.trials(spark, sf).withColumn("owner", owner("task_id"))
    return joins.attach_domain(owned, v.domains(spark, sf)).select("task_id", "sample_index", "domain")


@check(
    "j3_pair_arms",
    v.with_views("SELECT owner, sample_index, round(t, 6) AS f2p_treatment, round(c, 6) AS f2p_control FROM pairs", T, v.PAIRS),
)
def j3(spark, sf):
    keyed, keys = with_key(v.trials(spark, sf), "owner", "owner"), ["owner", "sample_index"]
    return joins.pair_arms(rates.f2p(keyed, keys), rates.f2p(keyed, keys, "base_state"), keys)


@check(
    "j4_pair_arms_outer",
    v.with_views(
        f"""SELECT repo, sample_index, round(a.f2p, 6) AS f2p_treatment, round(b.f2p, 6) AS f2p_control,
          CASE WHEN b.f2p IS NULL THEN 'treatment_only' WHEN a.f2p IS NULL THEN 'control_only' ELSE 'both' END AS matched
        FROM (SELECT {v.REPO} AS repo, sample_index, {v.F2P_SQL} AS f2p FROM trials WHERE initial_state = 'fail' GROUP BY 1, 2) a
        FULL JOIN (SELECT {v.REPO} AS repo, sample_index,
          {v.rate_sql("count(*) FILTER (base_state = 'pass')", "count(*)")} AS f2p
          FROM trials WHERE final_state <> 'INVALID' AND initial_state = 'fail' GROUP BY 1, 2) b USING (repo, sample_index)""",
        T,
    ),
)
def j4(spark, sf):
    keyed, keys = with_key(v.trials(spark, sf), "repo", "repo"), ["repo", "sample_index"]
    failing = keyed.filter(initially_failing())
    return joins.pair_arms_outer(
        rates.f2p(failing, keys), rates.f2p(failing.filter(~is_invalid()), keys, "base_state"), keys
    )


@check(
    "j6_repeats",
    v.with_views("SELECT instance_id, CAST(i AS INTEGER) AS sample_index FROM tasks, generate_series(2, 5) s(i)", v.TASKS),
)
def j6(spark, sf):
    return joins.expand_repeats(v.tasks(spark, sf).select("instance_id"), end=5, start=2)


# --- rates ----------------------------------------------------------------------------------------


@check("a1_f2p_rate", v.with_views(f"SELECT {v.F2P_COLUMNS} FROM trials", T))
def a1(spark, sf):
    return rates.f2p(v.trials(spark, sf))


@check("a2_f2p_by_run", v.with_views(f"SELECT sample_index, {v.F2P_COLUMNS} FROM trials GROUP BY sample_index", T))
def a2(spark, sf):
    return rates.f2p_by_run(v.trials(spark, sf))


@check("a3_macro_average", v.with_views(f"SELECT round(avg(f2p), 6) AS macro_f2p FROM (SELECT {v.F2P_SQL} AS f2p FROM trials GROUP BY sample_index)", T))
def a3(spark, sf):
    return rates.macro_average(rates.f2p_by_run(v.trials(spark, sf)))


@check("a4_micro_average", v.with_views(f"SELECT {v.F2P_COLUMNS.replace('AS f2p', 'AS micro_f2p')} FROM trials", T))
def a4(spark, sf):
    return rates.micro_average(v.trials(spark, sf))


LONG = """arms AS (
  SELECT task_id, sample_index, initial_state, 'treatment' AS arm, final_state FROM trials
  UNION ALL SELECT task_id, sample_index, initial_state, 'control', base_state FROM trials)"""
ARMS = {"treatment": "final_state", "control": "base_state"}


@check("a5_f2p_by_repo_run", v.with_views(f"SELECT arm, {v.REPO} AS repo, sample_index, {v.F2P_COLUMNS} FROM arms GROUP BY 1, 2, 3", T, LONG))
def a5(spark, sf):
    keyed = with_key(rates.arms_long(v.trials(spark, sf), ARMS), "repo", "repo")
    return rates.f2p(keyed, ["arm", "repo", "sample_index"])


@check("a6_f2p_by_owner_run", v.with_views(f"SELECT arm, {v.OWNER} AS owner, sample_index, {v.F2P_COLUMNS} FROM arms GROUP BY 1, 2, 3", T, LONG))
def a6(spark, sf):
    keyed = with_key(rates.arms_long(v.trials(spark, sf), ARMS), "owner", "owner")
    return rates.f2p(keyed, ["arm", "owner", "sample_index"])


TASK_SUMS = f"""task_sums AS (
  SELECT task_id, coalesce(min(domain), '{v.DEFAULT_DOMAIN}') AS domain,
    count(*) FILTER (initial_state = 'fail') AS n_failing,
    count(*) FILTER (initial_state = 'fail' AND final_state = 'pass') AS n_rescued,
    count(*) FILTER (initial_state = 'fail' AND base_state = 'pass') AS n_control,
    max(CASE WHEN final_state = 'pass' THEN 1 ELSE 0 END) AS solved
  FROM trials LEFT JOIN domains ON {v.OWNER} = owner GROUP BY task_id)"""
BREAKDOWN = f"""count(*) AS tasks, {v.rate_sql("sum(n_control)", "sum(n_failing)")} AS control_f2p,
  {v.rate_sql("sum(n_rescued)", "sum(n_failing)")} AS pass1_f2p, {v.rate_sql("sum(solved)", "count(*)")} AS passk_rate"""


@check("a7_domain_breakdown", v.with_views(f"SELECT domain, {BREAKDOWN} FROM task_sums GROUP BY domain", T, v.DOMAINS, TASK_SUMS))
def a7(spark, sf):
    return domain_table(v.trials(spark, sf), v.domains(spark, sf))


@check(
    "a8_breakdown_with_total",
    v.with_views(f"SELECT domain, grouping(domain) = 1 AS is_total, {BREAKDOWN} FROM task_sums GROUP BY ROLLUP (domain)", T, v.DOMAINS, TASK_SUMS),
)
def a8(spark, sf):
    return domain_table(v.trials(spark, sf), v.domains(spark, sf), with_total=True)


# --- Pass@k ---------------------------------------------------------------------------------------


@check(
    "a9_pass_at_all",
    v.with_views(
        f"""SELECT count(*) AS n_tasks, CAST(sum(s) AS BIGINT) AS n_solved, {v.rate_sql("sum(s)", "count(*)")} AS pass_at_all
        FROM (SELECT max(CASE WHEN final_state = 'pass' THEN 1 ELSE 0 END) AS s FROM trials GROUP BY task_id)""",
        T,
    ),
)
def a9(spark, sf):
    return passk.pass_at_all(v.trials(spark, sf))


FIRST_PASS = "first_pass AS (SELECT task_id, min(sample_index) FILTER (final_state = 'pass') AS k1 FROM trials GROUP BY task_id)"


@check(
    "a10_pass_at_k",
    v.with_views(
        f"""SELECT CAST(k AS INTEGER) AS k, count(*) AS n_tasks, count(*) FILTER (k1 <= k) AS n_solved,
          {v.rate_sql("count(*) FILTER (k1 <= k)", "count(*)")} AS pass_at_k
        FROM first_pass, generate_series(1, 7) s(k) GROUP BY k""",
        T,
        FIRST_PASS,
    ),
)
def a10(spark, sf):
    return passk.pass_at_k(v.trials(spark, sf), range(1, v.RUNS + 1))


@check(
    "a10_pass_at_k_by_owner",
    v.with_views(
        f"""SELECT {v.OWNER} AS owner, CAST(k AS INTEGER) AS k, count(*) AS n_tasks, count(*) FILTER (k1 <= k) AS n_solved,
          {v.rate_sql("count(*) FILTER (k1 <= k)", "count(*)")} AS pass_at_k
        FROM first_pass, generate_series(1, 7) s(k) GROUP BY 1, 2""",
        T,
        FIRST_PASS,
    ),
)
def a10_owner(spark, sf):
    return passk.pass_at_k(with_key(v.trials(spark, sf), "owner", "owner"), range(1, v.RUNS + 1), keys=["owner"])


FIRSTS = """firsts AS (
  SELECT task_id, initial_state, final_state, n_trials FROM (
    SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sample_index, initial_state, final_state) AS r,
           count(*) OVER (PARTITION BY task_id) AS n_trials FROM trials) WHERE r = 1)"""


@check("a11_first_outcomes", v.with_views("SELECT task_id, initial_state, final_state, n_trials FROM firsts", T, FIRSTS))
def a11(spark, sf):
    return passk.first_outcomes(v.trials(spark, sf))


@check("a12_invalid_count", v.with_views("SELECT count(*) FILTER (final_state = 'INVALID') AS n_invalid FROM trials", T))
def a12(spark, sf):
    return rates.invalid_count(v.trials(spark, sf))


@check(
    "a13_funnel",
    v.with_views(
        f"""SELECT CAST(sum(n_trials) AS BIGINT) AS n_rows, count(*) AS n_tasks, {v.F2P_COLUMNS},
          count(*) FILTER (final_state = 'INVALID') AS n_invalid FROM firsts""",
        T,
        FIRSTS,
    ),
)
def a13(spark, sf):
    return rates.funnel(passk.first_outcomes(v.trials(spark, sf)))


@check("a14_distinct_counts", v.with_views(f"SELECT count(DISTINCT task_id) AS n_task_id, count(DISTINCT {v.OWNER}) AS n_owner FROM trials", T))
def a14(spark, sf):
    return rates.distinct_counts(v.trials(spark, sf).withColumn("owner", owner("task_id")), ["task_id", "owner"])


@check("a14_distinct_tasks_rolled_up", v.with_views(f"SELECT {v.OWNER} AS owner, count(DISTINCT task_id) AS n_task_id, count(DISTINCT sample_index) AS n_sample_index FROM trials GROUP BY 1", T))
def a14_rolled_up(spark, sf):
    """Tasks of each owner from sketches of its runs; an owner has far fewer tasks than a sketch holds, so it is exact."""
    named = v.trials(spark, sf).withColumn("owner", owner("task_id"))
    columns = ["task_id", "sample_index"]
    parts = sketches.distinct_sketches(named, ["owner", RUN], columns)
    return sketches.sketched_counts(sketches.merged_sketches(parts, ["owner"], columns), ["owner"], columns)


@check("a14_arm_overlap", v.with_views(
    f"""SELECT owner, count(*) FILTER (a AND b) AS n_common, count(*) FILTER (a AND NOT b) AS n_only_treatment,
          count(*) FILTER (b AND NOT a) AS n_only_control, count(*) FILTER (a OR b) AS n_either
        FROM (SELECT {v.OWNER} AS owner, task_id, bool_or(final_state = 'pass') AS a, bool_or(base_state = 'pass') AS b
              FROM trials GROUP BY 1, 2) GROUP BY 1 HAVING n_either > 0""", T))
def a14_overlap(spark, sf):
    """Tasks that either arm solved at least once, per owner: by both, by one alone."""
    named = v.trials(spark, sf).withColumn("owner", owner("task_id"))
    arms = [sketches.distinct_sketches(named.filter(F.col(c) == "pass"), ["owner"], ["task_id"]) for c in ("final_state", "base_state")]
    return sketches.overlap(*arms, ["owner"], "task_id", ("treatment", "control"))


@check("a15_distinct_values", v.with_views("SELECT DISTINCT task_id FROM trials", T))
def a15(spark, sf):
    return v.trials(spark, sf).select("task_id").distinct()


@check("w2_first_repeats", v.with_views(
    """SELECT task_id, sample_index, initial_state, final_state, CAST(r AS INTEGER) AS repeat FROM (
         SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sample_index, initial_state, final_state) AS r
         FROM trials) WHERE r <= 2""", T))
def w2(spark, sf):
    return passk.first_k_repeats(v.trials(spark, sf), 2).select(*TRIAL_COLUMNS, "repeat")


# --- dispersion -----------------------------------------------------------------------------------


def _dispersion_sql(value: str, source: str) -> str:
    return f"""count(*) AS n_values, round(avg({value}), 6) AS mean, round(median({value}), 6) AS median,
      round(stddev_pop({value}), 6) AS sd, round(quantile_cont({value}, 0.25), 6) AS p25,
      round(quantile_cont({value}, 0.75), 6) AS p75, round(min({value}), 6) AS min, round(max({value}), 6) AS max
      FROM {source}"""


BY_RUN = f"(SELECT {v.F2P_SQL} AS f2p FROM trials GROUP BY sample_index)"
BY_TASK = "(SELECT max(CASE WHEN final_state = 'pass' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS solved FROM trials GROUP BY task_id)"


@check(
    "a16_dispersion",
    v.with_views(
        f"SELECT 'pass_at_1' AS metric, {_dispersion_sql('f2p', BY_RUN)} UNION ALL SELECT 'pass_at_all', {_dispersion_sql('solved', BY_TASK)}",
        T,
    ),
)
def a16(spark, sf):
    trials = v.trials(spark, sf)
    solved = passk.solved_tasks(trials).select((F.col("solved").cast("int") * 100.0).alias("solved"))
    runs = quantiles.dispersion(rates.f2p_by_run(trials), "f2p")
    per_task = quantiles.dispersion(solved, "solved")
    return tables.union_arms({"pass_at_1": runs, "pass_at_all": per_task}, "metric")


@check("a16_price_dispersion_by_flag", f"SELECT l_returnflag AS flag, {_dispersion_sql('l_extendedprice', 'lineitem')} GROUP BY 1")
def a16_prices(spark, sf):
    prices = v.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return quantiles.dispersion(prices, "l_extendedprice", ["flag"])


@check("a17_run_consistency", v.with_views(f"SELECT round(avg(f2p), 6) AS mean, round(stddev_pop(f2p), 6) AS sd FROM {BY_RUN}", T))
def a17(spark, sf):
    return quantiles.dispersion(rates.f2p_by_run(v.trials(spark, sf)), "f2p").select("mean", "sd")


@check(
    "a18_box_plot",
    v.with_views(
        """SELECT arm, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          round(min(f2p) FILTER (f2p BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 6) AS whisker_low,
          round(max(f2p) FILTER (f2p BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 6) AS whisker_high,
          count(*) FILTER (NOT f2p BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outliers
        FROM box JOIN (SELECT arm, quantile_cont(f2p, 0.25) AS q1, median(f2p) AS median, quantile_cont(f2p, 0.75) AS q3
                       FROM box GROUP BY arm) USING (arm)
        GROUP BY arm, q1, median, q3""",
        T,
        v.PAIRS,
        "box AS (SELECT 'treatment' AS arm, t AS f2p FROM pairs UNION ALL SELECT 'control', c FROM pairs)",
    ),
)
def a18(spark, sf):
    keyed = with_key(rates.arms_long(v.trials(spark, sf), ARMS), "owner", "owner")
    return quantiles.box_plot(rates.f2p(keyed, ["arm", "owner", "sample_index"]), "f2p", "arm")


@check(
    "a19_turn_histogram",
    v.with_views(
        """SELECT CAST(b AS INTEGER) AS bin, round(lo + b * w, 6) AS bin_low, round(lo + (b + 1) * w, 6) AS bin_high,
          (SELECT count(*) FROM turns WHERE least(floor((n_turns - lo) / w), 24) = b) AS n
        FROM ends, generate_series(0, 24) s(b)""",
        v.TURNS,
        "ends AS (SELECT min(n_turns)::DOUBLE AS lo, (max(n_turns)::DOUBLE - min(n_turns)::DOUBLE) / 25.0::DOUBLE AS w FROM turns)",
    ),
)
def a19(spark, sf):
    return quantiles.histogram(v.turns(spark, sf), "n_turns", 25)


@check(
    "a20_ceiling_share",
    v.with_views(
        """SELECT count(*) AS n_values, round(avg(least(greatest(n_turns, 2), 8)::DOUBLE), 6) AS mean_capped,
          count(*) FILTER (n_turns >= 8) AS n_at_ceiling,
          round(count(*) FILTER (n_turns >= 8)::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE, 6) AS share_at_ceiling FROM turns""",
        v.TURNS,
    ),
)
def a20(spark, sf):
    return quantiles.ceiling_share(v.turns(spark, sf), "n_turns", 2, 8)


@check(
    "a21_outcome_shares",
    v.with_views(
        f"""SELECT outcome, count(*) AS n, {v.rate_sql("count(*)", "(sum(count(*)) OVER ())")} AS share FROM (
          SELECT CASE WHEN bool_or(final_state = 'pass') THEN 'solved' WHEN bool_or(final_state = 'INVALID') THEN 'invalid run'
                 ELSE 'unsolved' END AS outcome FROM trials GROUP BY task_id) GROUP BY outcome""",
        T,
    ),
)
def a21(spark, sf):
    return rates.shares(rates.task_outcomes(rates.task_summary(v.trials(spark, sf))), "outcome")


@check(
    "a22_transitions",
    v.with_views(
        """SELECT initial_state, count(*) FILTER (final_state = 'pass') AS to_pass,
          count(*) FILTER (final_state = 'fail') AS to_fail, count(*) FILTER (final_state = 'INVALID') AS to_invalid,
          count(*) FILTER (final_state NOT IN ('pass', 'fail', 'INVALID')) AS to_other FROM trials GROUP BY initial_state""",
        T,
    ),
)
def a22(spark, sf):
    return rates.transitions(v.trials(spark, sf))


# --- order, unions --------------------------------------------------------------------------------


@check("o1_sorted_trials", v.with_views("SELECT task_id, sample_index, initial_state, final_state FROM trials", T))
def o1(spark, sf):
    return tables.sorted_trials(v.trials(spark, sf).select(*TRIAL_COLUMNS))


@check("o2_domains_by_tasks", v.with_views(f"SELECT domain, {BREAKDOWN} FROM task_sums GROUP BY domain", T, v.DOMAINS, TASK_SUMS))
def o2(spark, sf):
    return tables.ranked_by(domain_table(v.trials(spark, sf), v.domains(spark, sf)), "tasks", "domain")


@check("o3_ordered_runs", v.with_views("SELECT DISTINCT sample_index FROM trials", T))
def o3(spark, sf):
    return tables.ordered_values(v.trials(spark, sf), "sample_index")


@check(
    "o4_largest_domains",
    v.with_views(f"SELECT domain, {BREAKDOWN} FROM task_sums GROUP BY domain ORDER BY tasks DESC, domain LIMIT 6", T, v.DOMAINS, TASK_SUMS),
)
def o4(spark, sf):
    return tables.top_groups(domain_table(v.trials(spark, sf), v.domains(spark, sf)), "tasks", "domain", 6)


@check(
    "u1_union_shards",
    v.with_views(
        "SELECT task_id, sample_index, initial_state, CASE WHEN sample_index % 2 = 1 THEN final_state END AS final_state FROM trials", T
    ),
)
def u1(spark, sf):
    trials = v.trials(spark, sf).select(*TRIAL_COLUMNS)
    odd = trials.filter("sample_index % 2 = 1").select(*reversed(TRIAL_COLUMNS))
    even = trials.filter("sample_index % 2 = 0").drop("final_state")
    return tables.union_shards([odd, even]).select(*TRIAL_COLUMNS)


@check("u2_union_arms", v.with_views("SELECT task_id, sample_index, arm, final_state FROM arms", T, LONG))
def u2(spark, sf):
    trials = v.trials(spark, sf)
    treatment = trials.select("task_id", "sample_index", "final_state")
    control = trials.select("task_id", "sample_index", F.col("base_state").alias("final_state"))
    return tables.union_arms({"treatment": treatment, "control": control})


@check(
    "u3_repeated_keys",
    v.with_views("SELECT task_id, sample_index, count(*) AS n_rows FROM trials GROUP BY 1, 2 HAVING count(*) > 1", T),
)
def u3(spark, sf):
    return tables.repeated_keys(v.trials(spark, sf))


@check(
    "u3_one_per_key",
    v.with_views(
        """SELECT task_id, sample_index, initial_state, final_state FROM (
          SELECT *, row_number() OVER (PARTITION BY task_id, sample_index ORDER BY initial_state, final_state) AS r FROM trials)
        WHERE r = 1""",
        T,
    ),
)
def u3_one(spark, sf):
    return tables.one_per_key(v.trials(spark, sf).select(*TRIAL_COLUMNS))
