"""Prompt texts from task rows, and run-log lines to and from typed columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt of the first step, with the task columns it shows.
EXPLORE_TEMPLATE = (
    "Explore the codebase and write/fix test cases for repo {repo}. "
    "Target function: {target_function}. Doc: {function_doc}"
)

# Labels of a run-log line, in line order, and what stands between its fields.
LOG_LABELS = ("Timestamp", "Model", "Task", "Sample", "State", "Cost", "Errors")
LOG_SEPARATOR = " | "

_LOG_PATTERN = "^" + r" \| ".join(f"{label}: (.*)" if label == "Errors" else f"{label}: (.*?)" for label in LOG_LABELS) + "$"


def render(template: str, null_text: str = "None") -> Column:
    """Fill ``{column}`` places of a template; a null shows as ``null_text``."""
    parts = re.split(r"\{(\w+)\}", template)
    texts = [
        F.lit(part) if i % 2 == 0 else F.coalesce(F.col(part).cast("string"), F.lit(null_text))
        for i, part in enumerate(parts)
        if part != ""
    ]
    return F.concat(*texts)


# A break in a text, and how a log line shows it; the backslash itself comes first.
_BREAKS = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"))


def _one_line(text: Column) -> Column:
    for plain, shown in _BREAKS:
        text = F.replace(text, F.lit(plain), F.lit(shown))
    return text


def _as_written(text: Column) -> Column:
    mark = F.lit("\x00")  # stands for an escaped backslash meanwhile
    text = F.replace(text, F.lit(_BREAKS[0][1]), mark)
    for plain, shown in _BREAKS[1:]:
        text = F.replace(text, F.lit(shown), F.lit(plain))
    return F.replace(text, mark, F.lit(_BREAKS[0][0]))


def log_line(ts: str, model: str, task_id: str, sample_index: str, state: str, cost: str, error: str) -> Column:
    """One run-log line: seconds since the epoch first, then the labelled fields."""
    seconds = F.format_string("%.6f", F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6))
    fields = [
        seconds,
        *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (model, task_id, sample_index, state, cost)],
        _one_line(F.coalesce(F.col(error).cast("string"), F.lit(""))),
    ]
    return F.concat_ws(
        LOG_SEPARATOR, *[F.concat(F.lit(f"{label}: "), field) for label, field in zip(LOG_LABELS, fields)]
    )


def parsed_log(line: str) -> list[Column]:
    """Typed columns of a run-log line; a line of another form gives nulls in all of them."""
    c = F.col(line)
    # All fields by one replacement, not each by a search of its own: no field holds the break that ends each of them here.
    taken = F.regexp_replace(c, _LOG_PATTERN, "".join(f"${i}\n" for i in range(1, len(LOG_LABELS) + 1)))
    fields = F.when(c.rlike(_LOG_PATTERN), F.split(taken, "\n"))

    def field(i: int) -> Column:
        return fields[i - 1]

    seconds = field(1).try_cast("decimal(20,6)")
    return [
        F.timestamp_micros((seconds * 1000000).cast("bigint")).alias("ts"),
        field(2).alias("model"),
        field(3).alias("task_id"),
        field(4).try_cast("int").alias("sample_index"),
        field(5).alias("state"),
        field(6).try_cast("double").alias("cost"),
        _as_written(field(7)).alias("error_msg"),
    ]
