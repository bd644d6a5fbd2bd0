"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.paired_checks import DOMAIN_VIEWS, TAILS, owner_pairs
from checks.rate_checks import COMPAT
from checks.registry import check
from trialstats.functions import hashing, keys, states, text
from trialstats.operators import joins, passk
from trialstats.plans import paired

T = v.TRIALS


@check("x1_owner", v.with_views(f"SELECT DISTINCT task_id, {v.OWNER} AS owner FROM trials", T))
def x1(spark, sf):
    return v.trials(spark, sf).select("task_id", keys.owner("task_id").alias("owner")).distinct()


# Part types such as `PROMO BRUSHED` have no `_`; with spaces turned into one they exercise every branch.
@check(
    "x1_owner_other_forms",
    """SELECT p_partkey, id, CASE WHEN id LIKE '%\\_\\_%' ESCAPE '\\' THEN split_part(id, '__', 1)
         WHEN id LIKE '%\\_%' ESCAPE '\\' THEN split_part(id, '_', 1) ELSE 'Other' END AS owner,
         CASE WHEN len(string_split(id, '_')) > 1 AND NOT regexp_full_match(string_split(id, '_')[-1], '[0-9]+')
              THEN string_split(id, '_')[1] || '/' || string_split(id, '_')[2] ELSE 'mock_owner/mock_project' END AS repo
       FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_type, ' ', '__') WHEN 1 THEN replace(p_type, ' ', '_')
               WHEN 2 THEN concat(p_brand, '_', p_size) ELSE p_brand END AS id FROM part)""",
)
def x1_forms(spark, sf):
    kind = F.col("p_partkey") % 4
    spelled = (
        F.when(kind == 0, F.replace("p_type", F.lit(" "), F.lit("__")))
        .when(kind == 1, F.replace("p_type", F.lit(" "), F.lit("_")))
        .when(kind == 2, F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string")))
        .otherwise(F.col("p_brand"))
    )
    ids = v.table(spark, sf, "part").select("p_partkey", spelled.alias("id"))
    return ids.select("p_partkey", "id", keys.owner("id").alias("owner"), keys.compat_repo("id").alias("repo"))


@check("x2_compat_repo", v.with_views(f"SELECT task_id, sample_index, {COMPAT} AS repo FROM trials", T))
def x2(spark, sf):
    return v.trials(spark, sf).select("task_id", "sample_index", keys.compat_repo("task_id").alias("repo"))


@check(
    "x3_true_repo",
    v.with_views(
        rf"SELECT task_id, sample_index, {v.REPO} AS repo, CAST(regexp_extract(task_id, '^(.+?)__(.+)-([0-9]+)$', 3) AS BIGINT) AS issue FROM trials",
        T,
    ),
)
def x3(spark, sf):
    return v.trials(spark, sf).select(
        "task_id", "sample_index", keys.true_repo("task_id").alias("repo"), keys.issue_number("task_id").alias("issue")
    )


@check(
    "x4_prompt_text",
    v.with_views(
        """SELECT instance_id, 'Explore the codebase and write/fix test cases for repo ' || coalesce(r, 'None') || '. Target function: '
             || target_function || '. Doc: ' || function_doc AS prompt
           FROM (SELECT *, CASE WHEN released THEN repo END AS r FROM tasks)""",
        v.TASKS,
    ),
)
def x4(spark, sf):
    tasks = v.tasks(spark, sf).withColumn("repo", F.when(F.col("released"), F.col("repo")))
    return tasks.select("instance_id", text.render(text.EXPLORE_TEMPLATE).alias("prompt"))


@check(
    "x5_retryable",
    v.with_views(
        """SELECT ts, task_id, error_msg,
             regexp_matches(lower(error_msg), 'rate_limit|429|503|unavailable|overloaded|timed out|timeout|connection') AS retryable
           FROM runlog""",
        v.RUNLOG,
    ),
)
def x5(spark, sf):
    return v.runlog(spark, sf).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "task_id", "error_msg", states.retryable("error_msg").alias("retryable")
    )


@check(
    "x6_outcome_state",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'INVALID' WHEN value < 5 OR value > 90 THEN 'INVALID'
         WHEN event_type = 'purchase' THEN 'pass' ELSE 'fail' END AS state FROM events""",
)
def x6(spark, sf):
    replies = v.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("value") >= 5, F.col("props")).alias("first_reply"),
        F.when(F.col("value") <= 90, F.col("props")).alias("second_reply"),
        F.when(F.col("event_type") == "error", "HTTP 503").alias("error"),
        (F.col("event_type") == "purchase").alias("verdict"),
    )
    return replies.select("event_id", states.outcome_state("first_reply", "second_reply", "error", "verdict").alias("state"))


@check(
    "x7_percent_text",
    v.with_views("SELECT owner, sample_index, printf('%.2f%%', t) AS rate_text, printf('%.6f', c / 100.0::DOUBLE) AS share_text FROM pairs", T, v.PAIRS),
)
def x7(spark, sf):
    pairs = owner_pairs(spark, sf).withColumn("share", F.col("f2p_control") / 100.0)
    return pairs.select(
        "owner", "sample_index", states.percent("f2p_treatment").alias("rate_text"), states.fixed("share", 6).alias("share_text")
    )


@check(
    "x8_padded_id",
    """SELECT o_orderkey, 'task_mock_' || CASE WHEN length(o_orderkey::VARCHAR) >= 4 THEN o_orderkey::VARCHAR
         ELSE lpad(o_orderkey::VARCHAR, 4, '0') END AS id FROM orders""",
)
def x8(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", keys.padded_id("o_orderkey", 4, "task_mock_").alias("id"))


@check(
    "x9_yes_no",
    v.with_views("SELECT g AS domain, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS rejected FROM tails", *DOMAIN_VIEWS, TAILS),
)
def x9(spark, sf):
    pairs = joins.attach_domain(owner_pairs(spark, sf), v.domains(spark, sf))
    compared = paired.paired_comparison(pairs, group_cols=["domain"], method="asymptotic").withColumn("flag", F.col("p_value") < 0.05)
    return compared.select("domain", states.yes_no("flag").alias("rejected"))


@check(
    "x10_sign_and_size",
    v.with_views("SELECT owner, sample_index, sign(t - c)::DOUBLE AS direction, round(abs(t - c), 6) AS size FROM pairs", T, v.PAIRS),
)
def x10(spark, sf):
    diff = F.col("f2p_treatment") - F.col("f2p_control")
    return owner_pairs(spark, sf).select("owner", "sample_index", F.signum(diff).alias("direction"), F.abs(diff).alias("size"))


@check(
    "x11_any_in_prefix",
    v.with_views(
        """SELECT task_id, bool_or(final_state = 'pass' AND r <= 2) AS by_2, bool_or(final_state = 'pass') AS by_3 FROM (
             SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sample_index, initial_state, final_state) AS r FROM trials)
           WHERE r <= 3 GROUP BY task_id""",
        T,
    ),
)
def x11(spark, sf):
    # Lists of at most three: only the first three trials of a task are collected.
    firsts = passk.first_k_repeats(v.trials(spark, sf), 3)
    entries = F.array_sort(F.collect_list(F.struct("repeat", "final_state")))
    lists = firsts.groupBy("task_id").agg(F.transform(entries, lambda e: e["final_state"]).alias("states"))
    return lists.select("task_id", states.any_success("states", 2).alias("by_2"), states.any_success("states").alias("by_3"))


@check("x12_clipped", v.with_views("SELECT task_no, CAST(greatest(least(n_turns, 6), 3) AS DOUBLE) AS n_turns FROM turns", v.TURNS))
def x12(spark, sf):
    return v.turns(spark, sf).select("task_no", states.clipped(F.col("n_turns").cast("double"), 3.0, 6.0).alias("n_turns"))


@check("x13_base_name", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS name FROM pages")
def x13(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", keys.base_name("url").alias("name"))


@check(
    "x14_parsed_log",
    v.with_views("SELECT ts, 'model-a' AS model, task_id, sample_index, state, cost, error_msg FROM runlog", v.RUNLOG),
)
def x14(spark, sf):
    line = text.log_line("ts", "model", "task_id", "sample_index", "state", "cost", "error_msg")
    lines = v.runlog(spark, sf).withColumn("model", F.lit("model-a")).select(line.alias("line"))
    return lines.select(*text.parsed_log("line")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@check(
    "w3_hash_shard",
    v.with_views(
        "SELECT instance_id, CAST(('0x' || substr(md5(instance_id), 1, 8))::UBIGINT % 16 AS INTEGER) AS shard FROM tasks", v.TASKS
    ),
)
def hash_shards(spark, sf):
    return v.tasks(spark, sf).select("instance_id", hashing.hash_shard("instance_id", 16).alias("shard"))
