"""Ranks, paired tests, effect sizes, samples and control arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from trialstats.functions.states import decision, effect_label
from trialstats.operators import joins, passk, rates, sampling
from trialstats.plans import paired, quantiles
from trialstats.plans.comparison import (
    compare_arms,
    domain_comparison,
    summary_report,
    summary_row,
    with_key,
)
from trialstats.plans.running import running_totals

T = v.TRIALS



def owner_pairs(spark, sf):
    return rates.paired_rates(with_key(v.trials(spark, sf), "owner", "owner"), ["owner", "sample_index"])


def ranks_sql(group: str, source: str) -> str:
    """Per-row average ranks of absolute differences, zero differences dropped."""
    return f"""ranks AS (
  SELECT {group} AS g, d, rank() OVER (PARTITION BY {group} ORDER BY abs(d))
         + (count(*) OVER (PARTITION BY {group}, abs(d)) - 1) / 2.0::DOUBLE AS r
  FROM (SELECT *, t - c AS d FROM {source}) WHERE d <> 0),
tests AS (
  SELECT g, count(*) AS n, sum(r) FILTER (d > 0) AS w, sum(r) FILTER (d < 0) AS l FROM ranks GROUP BY g),
tie_terms AS (
  SELECT g, sum(m * m * m - m) AS tie FROM (SELECT g, count(*)::DOUBLE AS m FROM ranks GROUP BY g, abs(d)) GROUP BY g),
signs AS (
  SELECT x.g, sum(sign(x.v - y.v))::DOUBLE AS s FROM (SELECT {group} AS g, t AS v FROM {source}) x
  JOIN (SELECT {group} AS g, c AS v FROM {source}) y ON x.g = y.g GROUP BY x.g),
compared AS (
  SELECT p.g, p.n_pairs, coalesce(n, 0) AS n_nonzero, mean_treatment, mean_control, coalesce(w, 0)::DOUBLE AS w_plus,
    coalesce(l, 0)::DOUBLE AS w_minus,
    (w - n * (n + 1) / 4.0::DOUBLE) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48.0::DOUBLE), 0) AS z,
    s AS sign_sum, s / (p.n_pairs * p.n_pairs)::DOUBLE AS cliffs_delta
  FROM (SELECT {group} AS g, count(*) AS n_pairs, avg(t) AS mean_treatment, avg(c) AS mean_control FROM {source} GROUP BY 1) p
  LEFT JOIN tests USING (g) LEFT JOIN tie_terms USING (g) JOIN signs USING (g))"""


OVERALL, BY_DOMAIN = ranks_sql("0", "pairs"), ranks_sql("domain", "domain_pairs")
DOMAIN_VIEWS = (T, v.DOMAINS, v.PAIRS, v.DOMAIN_PAIRS, BY_DOMAIN)
COMPARED = """n_pairs, n_nonzero, round(mean_treatment, 6) AS mean_treatment, round(mean_control, 6) AS mean_control,
  w_plus, w_minus, round(z, 6) AS z, round(cliffs_delta, 6) AS cliffs_delta"""
COMPARED_COLUMNS = ["n_pairs", "n_nonzero", "mean_treatment", "mean_control", "w_plus", "w_minus", "z", "cliffs_delta"]


@check(
    "w1_signed_ranks",
    v.with_views(
        """SELECT round(abs(d), 6) AS abs_diff, count(*) FILTER (d > 0) AS n_up, count(*) FILTER (d < 0) AS n_down,
          min(r) AS avg_rank FROM ranks GROUP BY abs(d)""",
        T,
        v.PAIRS,
        OVERALL,
    ),
)
def w1(spark, sf):
    return paired.signed_ranks(owner_pairs(spark, sf))


@check(
    "w1_signed_ranks_by_domain",
    v.with_views(
        """SELECT g AS domain, round(abs(d), 6) AS abs_diff, count(*) FILTER (d > 0) AS n_up,
          count(*) FILTER (d < 0) AS n_down, min(r) AS avg_rank FROM ranks GROUP BY g, abs(d)""",
        *DOMAIN_VIEWS,
    ),
)
def w1_domain(spark, sf):
    pairs = joins.attach_domain(owner_pairs(spark, sf), v.domains(spark, sf))
    return paired.signed_ranks(pairs, group_cols=["domain"])


@check(
    "w4_running_totals",
    """SELECT l_returnflag AS flag, l_extendedprice AS price, n,
         CAST(coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before,
         CAST(sum(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS n_total
       FROM (SELECT l_returnflag, l_extendedprice, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
)
def w4(spark, sf):
    prices = v.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price")
    )
    return running_totals(quantiles.value_counts(prices, "price", ["flag"]), ["flag"], "price", ["n"])


@check("t1_wilcoxon_w", v.with_views("SELECT n_nonzero, w_plus, w_minus FROM compared", T, v.PAIRS, OVERALL))
def t1(spark, sf):
    compared = paired.paired_comparison(owner_pairs(spark, sf), with_p=False)
    return compared.select("n_nonzero", "w_plus", "w_minus")


@check(
    "t1_wilcoxon_w_rounded_ties",
    v.with_views(
        "SELECT n_nonzero, w_plus, w_minus FROM compared",
        T,
        v.PAIRS,
        OVERALL.replace("SELECT *, t - c AS d FROM pairs", "SELECT *, round(t - c, 9) AS d FROM pairs"),
    ),
)
def t1_rounded(spark, sf):
    compared = paired.paired_comparison(owner_pairs(spark, sf), with_p=False, tie_decimals=9)
    return compared.select("n_nonzero", "w_plus", "w_minus")


# At most 7 pairs per owner, so 128 sign masks: every choice of signs is looked at.
@check(
    "t2_exact_p_by_owner",
    v.with_views(
        """SELECT p.owner, coalesce(m.n, 0) AS n_nonzero, coalesce(m.w, 0)::DOUBLE AS w_plus,
             round(coalesce(m.p, 1.0), 6)::DOUBLE AS p_value
           FROM (SELECT DISTINCT owner FROM pairs) p LEFT JOIN (
             SELECT g, any_value(n) AS n, any_value(w) AS w,
                    count(*) FILTER (masked >= w)::DOUBLE / count(*)::DOUBLE AS p
             FROM (SELECT o.g, o.n, o.w, mask,
                          coalesce(sum(o.r) FILTER ((mask >> (o.i - 1)) & 1 = 1), 0) AS masked
                   FROM (SELECT g, d, r, row_number() OVER (PARTITION BY g ORDER BY r, d) AS i,
                                count(*) OVER (PARTITION BY g) AS n,
                                coalesce(sum(r) FILTER (d > 0) OVER (PARTITION BY g), 0) AS w FROM ranks) o,
                        generate_series(0, 127) s(mask)
                   WHERE mask < (1 << o.n) GROUP BY o.g, o.n, o.w, mask)
             GROUP BY g) m ON m.g = p.owner""",
        T,
        v.PAIRS,
        ranks_sql("owner", "pairs"),
    ),
)
def t2(spark, sf):
    compared = paired.paired_comparison(owner_pairs(spark, sf), group_cols=["owner"], method="exact")
    return compared.select("owner", "n_nonzero", "w_plus", "p_value")


@check("t3_normal_z", v.with_views("SELECT n_nonzero, round(z, 6) AS z FROM compared", T, v.PAIRS, OVERALL))
def t3(spark, sf):
    return paired.paired_comparison(owner_pairs(spark, sf), with_p=False).select("n_nonzero", "z")


# The upper tail of the normal distribution, for an engine without erfc: a series near the middle (its
# terms by logarithms, as lists cannot carry a running product), the continued fraction further out.
TAILS = """tails AS (
  SELECT g, CASE WHEN z < 0 THEN 1 - t ELSE t END AS p FROM (
    SELECT g, z, CASE WHEN x = 0 THEN 0.5::DOUBLE
      WHEN x < 2 THEN 0.5::DOUBLE - bell * list_sum(list_transform(range(0, 81), lambda n:
        exp((2 * n + 1) * ln(x) + 2 * n * ln(2.0::DOUBLE) + lgamma(n + 1.0::DOUBLE) - lgamma(2.0::DOUBLE * n + 2))))
      ELSE 0.5::DOUBLE * bell / (x + list_reduce(list_transform(range(80, 0, -1), lambda n: n::DOUBLE),
        lambda acc, n: (n / 2.0::DOUBLE) / (x + acc), 0.0::DOUBLE)) END AS t
    FROM (SELECT g, z, abs(z) / sqrt(2.0::DOUBLE) AS x, exp(-z * z / 2) / sqrt(pi()) AS bell FROM compared)))"""


@check("t3_normal_p", v.with_views("SELECT round(log10(p), 6) AS log_p, round(p, 6) AS p_value FROM tails", T, v.PAIRS, OVERALL, TAILS))
def t3_p(spark, sf):
    compared = paired.paired_comparison(owner_pairs(spark, sf), method="asymptotic")
    return compared.select(F.log10("p_value").alias("log_p"), "p_value")


@check("t3_normal_p_by_domain", v.with_views("SELECT g AS domain, round(log10(p), 6) AS log_p FROM tails", *DOMAIN_VIEWS, TAILS))
def t3_p_domain(spark, sf):
    pairs = joins.attach_domain(owner_pairs(spark, sf), v.domains(spark, sf))
    compared = paired.paired_comparison(pairs, group_cols=["domain"], method="asymptotic")
    return compared.select("domain", F.log10("p_value").alias("log_p"))


@check(
    "t4_cliffs_delta",
    v.with_views("SELECT CAST(sign_sum AS BIGINT) AS sign_sum, round(cliffs_delta, 6) AS cliffs_delta FROM compared", T, v.PAIRS, OVERALL),
)
def t4(spark, sf):
    compared = paired.paired_comparison(owner_pairs(spark, sf), with_p=False)
    return compared.select(F.col("sign_sum").cast("bigint").alias("sign_sum"), "cliffs_delta")


@check(
    "j7_all_pairs_counts",
    v.with_views(
        """SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS n_treatment,
             (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS n_control, CAST(wins AS BIGINT) AS wins,
             CAST(losses AS BIGINT) AS losses, CAST(ties AS BIGINT) AS ties,
             round((wins - losses)::DOUBLE / (wins + losses + ties)::DOUBLE, 6) AS cliffs_delta
           FROM (SELECT sum(a.n * b.n) FILTER (a.q > b.q) AS wins, sum(a.n * b.n) FILTER (a.q < b.q) AS losses,
                        sum(a.n * b.n) FILTER (a.q = b.q) AS ties FROM
             (SELECT l_quantity AS q, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a,
             (SELECT l_quantity AS q, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b)""",
        T,
    ),
)
def j7(spark, sf):
    lines = v.table(spark, sf, "lineitem")
    counts = paired.cliffs_delta(lines, "l_quantity", "l_returnflag", "A", "R")
    return counts.select(
        "n_treatment", "n_control", *[F.col(c).cast("bigint").alias(c) for c in ("wins", "losses", "ties")], "cliffs_delta"
    )


@check(
    "t4_cliffs_delta_by_domain",
    v.with_views(
        """SELECT x.domain, round(sum(sign(x.t - y.c))::DOUBLE / count(*)::DOUBLE, 6) AS cliffs_delta
           FROM domain_pairs x JOIN domain_pairs y USING (domain) GROUP BY x.domain""",
        T,
        v.DOMAINS,
        v.PAIRS,
        v.DOMAIN_PAIRS,
    ),
)
def t4_domain(spark, sf):
    keyed = with_key(rates.arms_long(v.trials(spark, sf), {"t": "final_state", "c": "base_state"}), "owner", "owner")
    samples = joins.attach_domain(rates.f2p(keyed, ["arm", "owner", "sample_index"]), v.domains(spark, sf))
    return paired.cliffs_delta(samples, "f2p", "arm", "t", "c", ["domain"]).select("domain", "cliffs_delta")


# The chances of all sums of doubled ranks, one rank more at each step.
SIGNED_SUMS = (
    "diffs AS (SELECT domain, t - c AS d FROM domain_pairs WHERE t <> c)",
    """ranked AS (
      SELECT domain, d, (2 * rank() OVER (PARTITION BY domain ORDER BY abs(d)) + count(*) OVER (PARTITION BY domain, abs(d)) - 1)::BIGINT AS r
      FROM diffs)""",
    """listed AS (
      SELECT domain, list(r ORDER BY r) AS rs, count(*)::BIGINT AS n, coalesce(sum(r) FILTER (d > 0), 0)::BIGINT AS w2 FROM ranked GROUP BY domain)""",
    """dist AS (
      SELECT domain, rs, n, w2, 0::BIGINT AS i, list_transform(generate_series(0, n * (n + 1)), lambda k: CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p
      FROM listed
      UNION ALL
      SELECT domain, rs, n, w2, i + 1,
        list_transform(generate_series(1, n * (n + 1) + 1), lambda k: (p[k] + CASE WHEN k > rs[i + 1] THEN p[k - rs[i + 1]] ELSE 0.0::DOUBLE END) / 2.0::DOUBLE)
      FROM dist WHERE i < n)""",
)


@check(
    "t2_exact_p_by_domain",
    v.with_views(
        """SELECT domain, n AS n_nonzero, w2 / 2.0::DOUBLE AS w_plus, 'exact' AS p_method, round(list_sum(p[w2 + 1:]), 6) AS p_value
           FROM dist WHERE i = n""",
        T,
        v.DOMAINS,
        v.PAIRS,
        v.DOMAIN_PAIRS,
        *SIGNED_SUMS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def t2_domain(spark, sf):
    pairs = joins.attach_domain(owner_pairs(spark, sf), v.domains(spark, sf))
    compared = paired.paired_comparison(pairs, group_cols=["domain"], method="exact")
    return compared.filter("n_nonzero > 0").select("domain", "n_nonzero", "w_plus", "p_method", "p_value")


@check(
    "t5_effect_labels",
    v.with_views(
        """SELECT g AS domain,
             CASE WHEN abs(cliffs_delta) < 0.2 THEN 'Negligible' WHEN abs(cliffs_delta) < 0.5 THEN 'Medium' ELSE 'Large' END AS code_label,
             CASE WHEN abs(cliffs_delta) < 0.147 THEN 'Negligible' WHEN abs(cliffs_delta) < 0.33 THEN 'Small'
                  WHEN abs(cliffs_delta) < 0.474 THEN 'Medium' ELSE 'Large' END AS paper_label FROM compared""",
        *DOMAIN_VIEWS,
    ),
)
def t5(spark, sf):
    pairs = joins.attach_domain(owner_pairs(spark, sf), v.domains(spark, sf))
    compared = paired.paired_comparison(pairs, group_cols=["domain"], with_p=False)
    return compared.select(
        "domain",
        effect_label("cliffs_delta", "code").alias("code_label"),
        effect_label("cliffs_delta", "paper").alias("paper_label"),
    )


@check(
    "t6_decision",
    v.with_views(
        "SELECT g AS domain, p < 0.05 AND mean_treatment > 16.06 AS rejected FROM compared JOIN tails USING (g)",
        *DOMAIN_VIEWS,
        TAILS,
    ),
)
def t6(spark, sf):
    pairs = joins.attach_domain(owner_pairs(spark, sf), v.domains(spark, sf))
    compared = paired.paired_comparison(pairs, group_cols=["domain"], method="asymptotic")
    return compared.select("domain", decision("p_value", "mean_treatment").alias("rejected"))


@check(
    "t7_identical_arms",
    v.with_views(
        "SELECT count(*) AS n_pairs, 0::BIGINT AS n_nonzero, 0.0::DOUBLE AS w_plus, 1.0::DOUBLE AS p_value, 0.0::DOUBLE AS cliffs_delta FROM pairs",
        T,
        v.PAIRS,
    ),
)
def t7(spark, sf):
    compared = paired.paired_comparison(owner_pairs(spark, sf), "f2p_treatment", "f2p_treatment")
    return compared.select("n_pairs", "n_nonzero", "w_plus", "p_value", "cliffs_delta")


@check("t8_domain_tests", v.with_views(f"SELECT g AS domain, {COMPARED} FROM compared", *DOMAIN_VIEWS))
def t8(spark, sf):
    compared = domain_comparison(v.trials(spark, sf), v.domains(spark, sf), with_p=False)
    return compared.select("domain", *COMPARED_COLUMNS)


PASSK_PAIRS = f"""pairs AS (
  SELECT {v.OWNER} AS owner, count(*) FILTER (k1 <= 7)::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS t,
         count(*) FILTER (k1 <= 1)::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS c
  FROM (SELECT task_id, min(sample_index) FILTER (final_state = 'pass') AS k1 FROM trials GROUP BY task_id) GROUP BY 1)"""


@check("t9_passk_against_pass1", v.with_views(f"SELECT {COMPARED} FROM compared", T, PASSK_PAIRS, OVERALL))
def t9(spark, sf):
    curve = passk.pass_at_k(with_key(v.trials(spark, sf), "owner", "owner"), [1, v.RUNS], keys=["owner"])
    wide = curve.groupBy("owner").agg(
        F.max(F.when(F.col("k") == v.RUNS, F.col("pass_at_k"))).alias("f2p_treatment"),
        F.max(F.when(F.col("k") == 1, F.col("pass_at_k"))).alias("f2p_control"),
    )
    return paired.paired_comparison(wide, with_p=False).select(*COMPARED_COLUMNS)


@check("compare_arms", v.with_views(f"SELECT {COMPARED} FROM compared", T, v.PAIRS, OVERALL))
def compare(spark, sf):
    return compare_arms(v.trials(spark, sf), "owner", with_p=False).select(*COMPARED_COLUMNS)


@check(
    "compare_arms_by_repo",
    v.with_views(f"SELECT {COMPARED} FROM compared", T, v.REPO_PAIRS, ranks_sql("0", "repo_pairs")),
)
def compare_repo(spark, sf):
    return compare_arms(v.trials(spark, sf), "repo", with_p=False).select(*COMPARED_COLUMNS)


@check(
    "s13_metric_report",
    v.with_views(
        f"""SELECT * FROM (
          SELECT 'p-value' AS "Metric", printf('%.6f', p) AS "Value" FROM tails UNION ALL
          SELECT 'Agentic_F2P_Avg_Pass@1' AS "Metric", printf('%.2f%%', t) AS "Value" FROM
            (SELECT avg(f2p) AS t FROM (SELECT {v.F2P_SQL} AS f2p FROM trials GROUP BY sample_index))
          UNION ALL SELECT 'Agentic_F2P_Pass@3', printf('%.2f%%', avg(s) * 100) FROM
            (SELECT max(CASE WHEN final_state = 'pass' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM trials GROUP BY task_id)
          UNION ALL SELECT 'Baseline_F2P_Avg', printf('%.2f%%', t) FROM
            (SELECT avg(f2p) AS t FROM (SELECT {v.F2P_SQL.replace("final_state", "base_state")} AS f2p FROM trials GROUP BY sample_index))
          UNION ALL SELECT 'N_Observations', n_pairs::VARCHAR FROM compared
          UNION ALL SELECT 'Effect_Size_Cliffs_Delta', printf('%.4f', cliffs_delta) FROM compared
          UNION ALL SELECT 'Effect_Size_Description',
            CASE WHEN abs(cliffs_delta) < 0.2 THEN 'Negligible' WHEN abs(cliffs_delta) < 0.5 THEN 'Medium' ELSE 'Large' END FROM compared
          UNION ALL SELECT 'Reject_H0', CASE WHEN p < 0.05 AND mean_treatment > 16.06 THEN 'Yes' ELSE 'No' END FROM compared, tails)""",
        T,
        v.PAIRS,
        OVERALL,
        TAILS,
    ),
)
def s13(spark, sf):
    return summary_report(summary_row(v.trials(spark, sf), "owner", method="asymptotic"))


# --- samples and control arms ---------------------------------------------------------------------

HASHED = "hashed AS (SELECT instance_id, row_number() OVER (ORDER BY md5('42|' || instance_id)) AS i, count(*) OVER () AS n FROM tasks)"


@check("l1_sampled_ids", v.with_views("SELECT instance_id FROM hashed WHERE i <= round_even(n * 0.1::DOUBLE, 0)", v.TASKS, HASHED))
def l1(spark, sf):
    return sampling.sample_ids(v.tasks(spark, sf), "instance_id", 0.1)


@check(
    "j5_rows_of_sampled_ids",
    v.with_views(
        "SELECT task_id, sample_index, final_state FROM trials WHERE task_id IN (SELECT instance_id FROM hashed WHERE i <= round_even(n * 0.1::DOUBLE, 0))",
        T,
        v.TASKS,
        HASHED,
    ),
)
def j5(spark, sf):
    ids = sampling.sample_ids(v.tasks(spark, sf), "instance_id", 0.1)
    trials = v.trials(spark, sf).select("task_id", "sample_index", "final_state")
    return joins.keep_ids(trials, ids.withColumnRenamed("instance_id", "task_id"), "task_id")


@check("l2_sampled_rows", v.with_views("SELECT instance_id, repo FROM tasks JOIN hashed USING (instance_id) WHERE i <= 500", v.TASKS, HASHED))
def l2(spark, sf):
    return sampling.sample_n(v.tasks(spark, sf), "instance_id", 500).select("instance_id", "repo")


@check("l3_control_arm", v.with_views("SELECT task_id, sample_index, base_state FROM trials", T))
def l3(spark, sf):
    return v.trials(spark, sf).select("task_id", "sample_index", "base_state")


@check(
    "l4_stratified_sample",
    v.with_views(
        """SELECT function_doc, instance_id FROM (
             SELECT *, row_number() OVER (PARTITION BY function_doc ORDER BY md5('42|' || instance_id)) AS i,
                    count(*) OVER (PARTITION BY function_doc) AS n FROM tasks) WHERE i <= ceil(n * 0.1::DOUBLE)""",
        v.TASKS,
    ),
)
def l4(spark, sf):
    return sampling.sample_strata(v.tasks(spark, sf), "instance_id", "function_doc", 0.1)


@check(
    "w3_round_robin_shards",
    v.with_views(
        "SELECT instance_id, CAST((row_number() OVER (ORDER BY instance_id) - 1) % 16 AS INTEGER) AS shard FROM tasks", v.TASKS
    ),
)
def w3(spark, sf):
    return sampling.round_robin_shards(v.tasks(spark, sf), "instance_id", 16)
