"""Writers of result tables, partitioned so that repeated and parallel runs do not clash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.functions.text import log_line
from trialstats.schema import TRIAL_KEY, TRIAL_SCHEMA
from trialstats.sources.paths import matching


# As ``readers.CSV`` reads it; blanks and breaks at the ends of a text are part of it.
CSV_OUT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header line, one per partition of ``df``."""
    df.write.mode(mode).options(**CSV_OUT).csv(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report of a few rows as a single CSV file. Result tables go through ``write_csv``."""
    report.coalesce(1).write.mode(mode).options(**CSV_OUT).csv(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("shard", "sample_index")) -> None:
    """Parquet by shard and run; only the partitions present in ``df`` are replaced.

    Rows are gathered by partition first, else every task writes a file to every partition; being a
    rebalance, a partition that holds most of the rows is split over tasks again.
    """
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def append_log(runs: DataFrame, path: str) -> None:
    """Append run-log lines; ``runs`` has ts, model, task_id, sample_index, state, cost, error_msg."""
    line = log_line("ts", "model", "task_id", "sample_index", "state", "cost", "error_msg")
    runs.select(line.alias("value")).write.mode("append").text(path)


def remaining_trials(planned: DataFrame, written: DataFrame, keys: Sequence[str] = TRIAL_KEY) -> DataFrame:
    """Planned trials with no written result: what an interrupted run still has to do.

    Written keys are made distinct first (combined before the shuffle), so a key that was written
    over and over costs no more than one that was written once.
    """
    return planned.join(written.select(*keys).distinct(), list(keys), "left_anti")


def written_results(spark: SparkSession, path: str) -> DataFrame:
    """Results appended so far, in one folder or by shard and run; an empty table where nothing was written yet."""
    if any(matching(spark, f"{path}/{below}*.parquet") for below in ("", "*=*/", "*=*/*=*/")):
        return spark.read.schema(TRIAL_SCHEMA).parquet(path)
    return spark.createDataFrame([], TRIAL_SCHEMA)


def append_results(results: DataFrame, path: str, keys: Sequence[str] = TRIAL_KEY) -> None:
    """Append the results whose key is not written yet, so a batch may be sent again."""
    written = written_results(results.sparkSession, path)
    remaining_trials(results, written, keys).select(*TRIAL_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def metric_report(row: DataFrame, metrics: Sequence[tuple[str, str]]) -> DataFrame:
    """Turn columns of a one-row table into (Metric, Value) rows; ``metrics`` pairs a name with a text column."""
    pairs = [
        F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("Metric"), F.col(column).cast("string").alias("Value")
        )
        for i, (name, column) in enumerate(metrics)
    ]
    return row.select(F.inline(F.array(*pairs))).orderBy("position").select("Metric", "Value")
