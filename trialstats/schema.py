"""Declared schemas and the fixed vocabulary of trial outcomes."""

from __future__ import annotations

from pyspark.sql import types as T

# The state texts used in outcome files.
PASS = "pass"
FAIL = "fail"
INVALID = "INVALID"

FINAL_STATES = (PASS, FAIL, INVALID)

TRIAL_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("sample_index", T.IntegerType()),
        T.StructField("initial_state", T.StringType()),
        T.StructField("final_state", T.StringType()),
    ]
)

TASK_SCHEMA = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("target_function", T.StringType()),
        T.StructField("function_doc", T.StringType()),
    ]
)

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("Metric", T.StringType()),
        T.StructField("Value", T.StringType()),
    ]
)

# The key that identifies one trial.
TRIAL_KEY = ("task_id", "sample_index")
