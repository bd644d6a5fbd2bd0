"""Sources, sinks and streams: tables are written to a new shared folder and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from trialstats.functions import hashing, text
from trialstats.operators import joins, rates
from trialstats.schema import TRIAL_SCHEMA
from trialstats.session import shared_path
from trialstats.sources import readers, writers
from trialstats.sources.paths import base_name, matching
from trialstats.streaming import feeds

T = v.TRIALS
COLUMNS = TRIAL_SCHEMA.fieldNames()
ALL_TRIALS = "SELECT task_id, sample_index, initial_state, final_state FROM trials"


def trial_rows(spark, sf):
    return v.trials(spark, sf).select(*COLUMNS)


def csv_shards(spark, sf, name):
    """Trials as CSV shards, one folder per run."""
    path = shared_path(spark, name)
    writers.write_csv(trial_rows(spark, sf), path)
    return path


@check("s1_csv_shards", v.with_views(ALL_TRIALS, T))
def s1(spark, sf):
    path = csv_shards(spark, sf, "shards")
    return readers.read_shards(spark, f"{path}/part-*.csv")


@check("s2_ignored_names", v.with_views(f"{ALL_TRIALS} WHERE sample_index <= 3", T))
def s2(spark, sf):
    path = shared_path(spark, "shards")
    writers.write_csv(trial_rows(spark, sf).filter("sample_index <= 3"), path)
    kept = set(matching(spark, f"{path}/part-*.csv"))
    writers.write_csv(trial_rows(spark, sf), path, "append")
    later = [base_name(p) for p in matching(spark, f"{path}/part-*.csv") if p not in kept]
    return readers.read_shards(spark, f"{path}/part-*.csv", ignored=later)


@check("s3_first_pattern", v.with_views(ALL_TRIALS, T))
def s3(spark, sf):
    path = csv_shards(spark, sf, "shards")
    return readers.read_shards(spark, [f"{path}/missing-*.csv", f"{path}/part-*.csv", f"{path}/*"])


@check(
    "s4_rejected_lines",
    "SELECT count(*) AS n_rejected FROM events",
)
def s4(spark, sf):
    path = csv_shards(spark, sf, "shards")
    v.table(spark, sf, "events").select("event_id", "event_type").write.mode("append").option("header", True).csv(path)
    return readers.rejected_lines(spark, f"{path}/part-*.csv").agg(F.count("*").alias("n_rejected"))


@check("s4_rejected_texts", "SELECT concat(event_id, ',', event_type) AS line FROM events")
def s4_texts(spark, sf):
    """Every rejected line as it stands in its file."""
    path = csv_shards(spark, sf, "shards")
    v.table(spark, sf, "events").select("event_id", "event_type").write.mode("append").option("header", True).csv(path)
    return readers.rejected_lines(spark, f"{path}/part-*.csv").select("line")


@check("s1_quoted_breaks", "SELECT o_orderkey, concat(o_orderstatus, chr(10), '\"', o_orderpriority, '\",', chr(10)) AS note, o_totalprice FROM orders")
def s1_breaks(spark, sf):
    """Shards with texts over several lines, beside shards without any."""
    path = shared_path(spark, "shards")
    note = F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('",\n'))
    orders = v.table(spark, sf, "orders").select("o_orderkey", note.alias("note"), "o_totalprice")
    writers.write_csv(orders, path)
    return readers.read_shards(spark, f"{path}/part-*.csv", schema=orders.schema)


@check("s4_kept_lines", v.with_views(ALL_TRIALS, T))
def s4_kept(spark, sf):
    path = csv_shards(spark, sf, "shards")
    v.table(spark, sf, "events").select("event_id", "event_type").write.mode("append").option("header", True).csv(path)
    return readers.read_shards(spark, f"{path}/part-*.csv")


@check("s5_csv_tasks", v.with_views("SELECT instance_id, repo, target_function, function_doc FROM tasks", v.TASKS))
def s5(spark, sf):
    path = shared_path(spark, "tasks")
    writers.write_csv(v.tasks(spark, sf).drop("released"), path)
    return readers.read_tasks(spark, [("json", f"{path}-missing"), ("csv", path)])


@check("s6_json_lines", v.with_views("SELECT instance_id, repo, target_function, function_doc FROM tasks", v.TASKS))
def s6(spark, sf):
    path = shared_path(spark, "tasks")
    v.tasks(spark, sf).drop("released").write.json(path)
    return readers.read_json_lines(spark, path)


TASK_ROWS = v.with_views("SELECT instance_id, repo, target_function, function_doc FROM tasks", v.TASKS)


@check("s11_task_ids", TASK_ROWS)
def s11(spark, sf):
    path = shared_path(spark, "tasks")
    v.tasks(spark, sf).drop("released").withColumnRenamed("instance_id", "task_id").write.json(path)
    return readers.read_tasks(spark, [("parquet", f"{path}-missing"), ("json", path)])


@check("p8_id_column", TASK_ROWS)
def p8(spark, sf):
    path = shared_path(spark, "tasks")
    v.tasks(spark, sf).select("released", "repo", F.col("instance_id").alias("id"), "target_function", "function_doc").write.parquet(path)
    return readers.read_tasks(spark, [("parquet", path)]).drop("released")


@check("s9_parquet", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def s9(spark, sf):
    lines = readers.read_parquet(spark, f"{sf}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@check("s10_parquet_tree", v.with_views(ALL_TRIALS, T))
def s10(spark, sf):
    root = shared_path(spark, "tree")
    trial_rows(spark, sf).write.parquet(f"{root}/runs/a")
    trial_rows(spark, sf).write.parquet(f"{root}/.venv/lib")
    trial_rows(spark, sf).write.parquet(f"{root}/my-env/lib")
    return readers.read_parquet_tree(spark, root).select(*COLUMNS)


SHARD = "CAST(('0x' || substr(md5(task_id), 1, 8))::UBIGINT % 4 AS INTEGER)"


@check(
    "s15_partitioned_results",
    v.with_views(f"SELECT task_id, initial_state, final_state, {SHARD} AS shard, sample_index FROM trials", T),
)
def s15(spark, sf):
    path = shared_path(spark, "results")
    sharded = trial_rows(spark, sf).withColumn("shard", hashing.hash_shard("task_id", 4))
    writers.write_partitioned(sharded, path)
    # Two runs again: their partitions are replaced, the others stay.
    writers.write_partitioned(sharded.filter("sample_index IN (2, 3)"), path)
    return spark.read.parquet(path)


@check(
    "s14_log_lines",
    v.with_views("SELECT state, 2 * count(*) AS n_lines, 2 * count(*) FILTER (error_msg <> '') AS n_errors FROM runlog GROUP BY state", v.RUNLOG),
)
def s14(spark, sf):
    path = shared_path(spark, "log")
    runs = v.runlog(spark, sf).withColumn("model", F.lit("model-a"))
    writers.append_log(runs, path)
    writers.append_log(runs, path)
    lines = spark.read.text(path).select(*text.parsed_log("value"))
    return lines.groupBy("state").agg(F.count("*").alias("n_lines"), F.count_if(F.col("error_msg") != "").alias("n_errors"))


@check("s14_log_rows", v.with_views(
    """SELECT epoch_us(ts) AS micros, 'model-a' AS model, task_id, sample_index, state, round(cost, 6) AS cost, error_msg FROM runlog""", v.RUNLOG))
def s14_rows(spark, sf):
    """Every line of the log as it was written, all fields."""
    path = shared_path(spark, "log")
    writers.append_log(v.runlog(spark, sf).withColumn("model", F.lit("model-a")), path)
    lines = spark.read.text(path).select(*text.parsed_log("value"))
    return lines.withColumn("micros", F.unix_micros("ts")).drop("ts")


@check(
    "s16_remaining_trials",
    v.with_views(
        """SELECT instance_id AS task_id, CAST(i AS INTEGER) AS sample_index FROM tasks, generate_series(1, 7) s(i)
           WHERE NOT EXISTS (SELECT 1 FROM trials t WHERE t.task_id = instance_id AND t.sample_index = i)""",
        T,
        v.TASKS,
    ),
)
def s16(spark, sf):
    planned = joins.expand_repeats(v.tasks(spark, sf).select(F.col("instance_id").alias("task_id")), v.RUNS)
    return writers.remaining_trials(planned, v.trials(spark, sf))


@check("s16_resumed_results", v.with_views(ALL_TRIALS, T))
def s16_resumed(spark, sf):
    path = shared_path(spark, "results")
    trials = trial_rows(spark, sf)
    writers.append_results(trials.filter("sample_index <= 4"), path)
    writers.append_results(trials, path)
    return readers.read_parquet(spark, path)


@check(
    "p9_default_ids",
    "SELECT count(*) AS n_rows, count(*) AS n_ids, 'task_0' AS first_id, count(*) - 1 AS last_number FROM events",
)
def p9(spark, sf):
    numbered = readers.with_task_id(v.table(spark, sf, "events"))
    number = F.split_part("instance_id", F.lit("_"), F.lit(2)).cast("bigint")
    return numbered.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("instance_id").alias("n_ids"),
        F.min("instance_id").alias("first_id"),
        F.max(number).alias("last_number"),
    )


@check("p9_ids_in_row_order", "SELECT concat('task_', row_number() OVER (ORDER BY event_id) - 1) AS instance_id, event_id, user_id FROM events")
def p9_rows(spark, sf):
    """Ids of all rows, which were put in order beforehand."""
    return readers.with_task_id(v.table(spark, sf, "events").select("event_id", "user_id").orderBy("event_id"))


@check(
    "p10_table_profile",
    """SELECT count(*) AS n_rows, 6::BIGINT AS n_columns,
         'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS column_names FROM orders""",
)
def p10(spark, sf):
    return readers.table_profile(v.table(spark, sf, "orders"))


# --- streams --------------------------------------------------------------------------------------


# Micro-batches that a feed takes at least, and files of one: a file is read by few tasks, however large it is.
BATCHES = 4
FILES = 24


def mixed_shards(spark, sf, name):
    """Trials as CSV shards of two headers, in files enough for ``BATCHES`` micro-batches of two."""
    path = shared_path(spark, name)
    trials = trial_rows(spark, sf)
    for columns, half in ((COLUMNS, "sample_index <= 3"), (COLUMNS[::-1], "sample_index > 3")):
        trials.filter(half).select(*columns).repartition(BATCHES).write.mode("append").options(**writers.CSV_OUT).csv(path)
    return path


@check("m1_run_rate_feed", v.with_views(f"SELECT sample_index, {v.F2P_COLUMNS} FROM trials GROUP BY sample_index", T))
def m1(spark, sf):
    shards = mixed_shards(spark, sf, "shards")
    out = shared_path(spark, "run-rates")
    feeds.run_rate_feed(spark, shards, out, f"{out}-state", max_files=2).awaitTermination()
    return feeds.current_rates(spark, out)


@check(
    "m2_result_feed",
    v.with_views(
        """SELECT task_id, sample_index, initial_state, final_state FROM (
          SELECT *, row_number() OVER (PARTITION BY task_id, sample_index ORDER BY initial_state, final_state) AS r FROM trials)
        WHERE r = 1""",
        T,
    ),
)
def m2(spark, sf):
    shipped = v.table(spark, sf, "lineitem").select(v.task_of_line().alias("task_id"), F.col("l_linenumber").alias("sample_index"), *v.states_of_line(), F.col("l_shipdate").cast("timestamp").alias("ts"))
    shards, out = shared_path(spark, "shards"), shared_path(spark, "results")
    shipped.repartition(BATCHES * FILES).write.parquet(shards)
    stream = spark.readStream.schema(shipped.schema).option("maxFilesPerTrigger", FILES).parquet(shards)
    feeds.result_feed(stream, out, f"{out}-state").awaitTermination()
    return feeds.result_table(spark, out).select(*COLUMNS)


def logged_results(spark, sf, newest_first):
    """The first result of every trial, from a run log that arrives as files of succeeding times, in that order or against it."""
    log, out = shared_path(spark, "log"), shared_path(spark, "results")
    runs = v.runlog(spark, sf).withColumn("model", F.lit("model-a")).repartitionByRange(BATCHES, "ts")
    writers.append_log(runs, log)
    lines = spark.readStream.option("latestFirst", newest_first).option("maxFilesPerTrigger", 1).text(log)
    parsed = lines.select(*text.parsed_log("value")).select("task_id", "sample_index", "ts", "state", "cost", "error_msg")
    feeds.result_feed(parsed, out, f"{out}-state", keep="2 days").awaitTermination()
    return feeds.result_table(spark, out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


FIRST_LOGGED = v.with_views(
    """SELECT task_id, sample_index, ts, state, round(cost, 6) AS cost, error_msg FROM (
      SELECT *, row_number() OVER (PARTITION BY task_id, sample_index ORDER BY ts, state, cost, error_msg) AS r FROM runlog)
    WHERE r = 1""",
    v.RUNLOG,
)


@check("m2_logged_results", FIRST_LOGGED)
def m2_logged(spark, sf):
    return logged_results(spark, sf, newest_first=False)


@check("m2_logged_results_newest_first", FIRST_LOGGED)
def m2_logged_reversed(spark, sf):
    return logged_results(spark, sf, newest_first=True)


@check(
    "m2_recent_repeats",
    v.with_views("SELECT DISTINCT task_id, sample_index FROM runlog", v.RUNLOG),
)
def m2_recent(spark, sf):
    out = shared_path(spark, "distinct-runs")
    kept = feeds.drop_recent_repeats(event_stream(spark, sf), delay="3650 days")
    feeds_query = (
        kept.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{out}-state")
        .trigger(availableNow=True)
        .start()
    )
    feeds_query.awaitTermination()
    return spark.read.parquet(out).select("task_id", "sample_index")


HEALTH = f"""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
  count(*) AS n_trials, count(*) FILTER (state = 'INVALID') AS n_invalid,
  count(*) FILTER (regexp_matches(lower(error_msg), 'rate_limit|429|503|unavailable|overloaded|timed out|timeout|connection')) AS n_retryable,
  {v.rate_sql("count(*) FILTER (state = 'INVALID')", "count(*)")} AS invalid_rate FROM runlog GROUP BY 1, 2"""


def without_zone(df):
    """Windows as zone-less timestamps, as the events carry."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@check("m3_health_by_window", v.with_views(HEALTH, v.RUNLOG))
def m3(spark, sf):
    return without_zone(feeds.health_by_window(v.runlog(spark, sf)))


def event_stream(spark, sf):
    """The events table as a stream of run-log rows."""
    schema = v.table(spark, sf, "events").schema
    return v.as_runlog(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


@check(
    "m3_health_feed",
    v.with_views(f"SELECT * FROM ({HEALTH}) WHERE window_end <= (SELECT max(ts) - INTERVAL '10 minutes' FROM runlog)", v.RUNLOG),
)
def m3_feed(spark, sf):
    out = shared_path(spark, "health")
    feeds.health_feed(event_stream(spark, sf), out, f"{out}-state").awaitTermination()
    return without_zone(spark.read.parquet(out))
