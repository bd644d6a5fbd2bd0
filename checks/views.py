"""Trial-shaped views over the test tables, in Spark and as SQL text.

Every view reads its tables whole: trials are all line items (runs 1 to 7), tasks all orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.functions.keys import DEFAULT_DOMAIN
from trialstats.sources.readers import read_parquet

RUNS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _task_id(key: str):
    k = F.col(key)
    return F.concat(F.lit("own"), (k % 400).cast("string"), F.lit("__repo"), (k % 7).cast("string"), F.lit("-"), k.cast("string"))


def task_of_line() -> Column:
    return _task_id("l_orderkey")


def states_of_line() -> list[Column]:
    """Initial and final state of a line item."""
    return [
        F.when(F.col("l_returnflag") == "N", "pass").otherwise("fail").alias("initial_state"),
        F.when(F.col("l_quantity") == 50, "INVALID").when(F.col("l_quantity") <= 10, "pass").otherwise("fail").alias("final_state"),
    ]


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with the outcomes of two arms."""
    return table(spark, sf_dir, "lineitem").select(
        task_of_line().alias("task_id"),
        F.col("l_linenumber").alias("sample_index"),
        *states_of_line(),
        F.when(F.col("l_tax") <= 0.01, "pass").otherwise("fail").alias("base_state"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; ``released`` is false for orders that are still pending."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        _task_id("o_orderkey").alias("instance_id"),
        F.concat(
            F.lit("own"), (F.col("o_orderkey") % 400).cast("string"), F.lit("/repo"), (F.col("o_orderkey") % 7).cast("string")
        ).alias("repo"),
        F.concat(F.lit("test_"), F.lower("c_mktsegment")).alias("target_function"),
        F.col("o_orderpriority").alias("function_doc"),
        (F.col("o_orderstatus") != "P").alias("released"),
    )


def repo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of released tasks: on purpose not all, so that the computed key is needed too."""
    return tasks(spark, sf_dir).filter("released").select("instance_id", "repo")


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner to domain; owners whose number fits no nation have none."""
    owners = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 400).alias("number")).distinct()
    nations = table(spark, sf_dir, "nation")
    return owners.join(nations, F.col("number") % 32 == F.col("n_nationkey")).select(
        F.concat(F.lit("own"), F.col("number").cast("string")).alias("owner"), F.col("n_name").alias("domain")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("task_no")).agg(F.count("*").alias("n_turns"))
    )


def as_runlog(events: DataFrame) -> DataFrame:
    error = (
        F.when(F.col("event_type") != "error", "")
        .when(F.col("event_id") % 3 == 0, "HTTP 429 Rate_Limit")
        .when(F.col("event_id") % 3 == 1, "Request Timed Out")
        .otherwise("bad request")
    )
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("task_id"),
        (F.col("event_id") % 3 + 1).cast("int").alias("sample_index"),
        F.when(F.col("event_type") == "error", "INVALID")
        .when(F.col("event_type") == "purchase", "pass")
        .otherwise("fail")
        .alias("state"),
        F.col("value").alias("cost"),
        error.alias("error_msg"),
    )


def runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_runlog(table(spark, sf_dir, "events"))


TRIALS = """trials AS (
  SELECT concat('own', l_orderkey % 400, '__repo', l_orderkey % 7, '-', l_orderkey) AS task_id,
         l_linenumber AS sample_index,
         CASE WHEN l_returnflag = 'N' THEN 'pass' ELSE 'fail' END AS initial_state,
         CASE WHEN l_quantity = 50 THEN 'INVALID' WHEN l_quantity <= 10 THEN 'pass' ELSE 'fail' END AS final_state,
         CASE WHEN l_tax <= 0.01 THEN 'pass' ELSE 'fail' END AS base_state
  FROM lineitem)"""

TASKS = """tasks AS (
  SELECT concat('own', o_orderkey % 400, '__repo', o_orderkey % 7, '-', o_orderkey) AS instance_id,
         concat('own', o_orderkey % 400, '/repo', o_orderkey % 7) AS repo,
         concat('test_', lower(c_mktsegment)) AS target_function,
         o_orderpriority AS function_doc,
         o_orderstatus <> 'P' AS released
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

DOMAINS = """domains AS (
  SELECT concat('own', number) AS owner, n_name AS domain
  FROM (SELECT DISTINCT o_orderkey % 400 AS number FROM orders) JOIN nation ON number % 32 = n_nationkey)"""

TURNS = "turns AS (SELECT conv_id AS task_no, count(*) AS n_turns FROM conversations GROUP BY conv_id)"

RUNLOG = """runlog AS (
  SELECT ts, concat('user-', user_id) AS task_id, CAST(event_id % 3 + 1 AS INTEGER) AS sample_index,
         CASE event_type WHEN 'error' THEN 'INVALID' WHEN 'purchase' THEN 'pass' ELSE 'fail' END AS state,
         value AS cost,
         CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 3 = 0 THEN 'HTTP 429 Rate_Limit'
              WHEN event_id % 3 = 1 THEN 'Request Timed Out' ELSE 'bad request' END AS error_msg
  FROM events)"""

# Rates of both arms per owner and run, and per true repository and run.
_PAIRS = """{name} AS (
  SELECT {key} AS {alias}, sample_index,
         coalesce(count(*) FILTER (initial_state = 'fail' AND final_state = 'pass')::DOUBLE
                  / nullif(count(*) FILTER (initial_state = 'fail'), 0)::DOUBLE * 100.0::DOUBLE, 0.0::DOUBLE) AS t,
         coalesce(count(*) FILTER (initial_state = 'fail' AND base_state = 'pass')::DOUBLE
                  / nullif(count(*) FILTER (initial_state = 'fail'), 0)::DOUBLE * 100.0::DOUBLE, 0.0::DOUBLE) AS c
  FROM trials GROUP BY 1, 2)"""

OWNER = "split_part(task_id, '__', 1)"
REPO = r"regexp_extract(task_id, '^(.+?)__(.+)-([0-9]+)$', 1) || '/' || regexp_extract(task_id, '^(.+?)__(.+)-([0-9]+)$', 2)"
PAIRS = _PAIRS.format(name="pairs", key=OWNER, alias="owner")
REPO_PAIRS = _PAIRS.format(name="repo_pairs", key=REPO, alias="repo")
DOMAIN_PAIRS = f"""domain_pairs AS (
  SELECT coalesce(d.domain, '{DEFAULT_DOMAIN}') AS domain, owner, sample_index, t, c
  FROM pairs LEFT JOIN domains d USING (owner))"""


def with_views(body: str, *views: str) -> str:
    return f"WITH {', '.join(views)}\n{body}"


def rate_sql(part: str, whole: str) -> str:
    """SQL twin of ``rate``, rounded as all compared numbers are."""
    return f"round(coalesce(({part})::DOUBLE / nullif({whole}, 0)::DOUBLE * 100.0::DOUBLE, 0.0::DOUBLE), 6)"


F2P_SQL = rate_sql(
    "count(*) FILTER (initial_state = 'fail' AND final_state = 'pass')", "count(*) FILTER (initial_state = 'fail')"
)
F2P_COLUMNS = f"""count(*) FILTER (initial_state = 'fail') AS n_failing,
  count(*) FILTER (initial_state = 'fail' AND final_state = 'pass') AS n_rescued, {F2P_SQL} AS f2p"""
