"""Readers with declared schemas. Each is one lazy scan, however many files it covers (shards: one per header)."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.schema import TASK_SCHEMA, TRIAL_SCHEMA
from trialstats.session import stored_table
from trialstats.sources.paths import as_plain, base_name, first_lines, first_matching, qualified

# A header line, and a quote in a quoted text is doubled.
CSV = {"header": True, "quote": '"', "escape": '"'}

CORRUPT = "_corrupt_record"
SOURCE_FILE = "source_file"

# Texts that mean "no value" in outcome files.
NULL_TEXTS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")

# Names of the id column, best first.
ID_COLUMNS = ("instance_id", "task_id", "id", "index")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType = TRIAL_SCHEMA, null_texts: Sequence[str] = NULL_TEXTS
) -> DataFrame:
    """CSV with a header line: one file, a folder or a glob, in a single scan. Texts may hold quotes and line breaks.

    A header of other names, or in another order, is an error: columns are never taken by position. ``null_texts``
    are read as nulls.
    """
    rows = spark.read.schema(schema).options(**CSV).options(multiLine=True, enforceSchema=False).csv(path)
    return texts_to_null(rows, null_texts)


def texts_to_null(df: DataFrame, texts: Sequence[str] = NULL_TEXTS) -> DataFrame:
    """Turn the null texts of string columns into nulls."""
    if not texts:
        return df
    return df.select(
        *[
            F.when(~F.col(f.name).isin(*texts), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_shards(
    spark: SparkSession,
    patterns: str | Sequence[str],
    ignored: Sequence[str] = (),
    schema: T.StructType = TRIAL_SCHEMA,
    null_texts: Sequence[str] = NULL_TEXTS,
) -> DataFrame:
    """Outcome shards of the first pattern that has files, less the files ignored by base name.

    Columns are matched by the names in each file's header: their order is free, missing ones are null, others are
    left out. Duplicates are kept. Lines that do not fit the schema, and all lines of a file that has none of its
    columns, are dropped here; ``rejected_lines`` shows them. Quoted texts may hold line breaks; ``null_texts`` are
    read as nulls.
    """
    return _fitting(_parsed_shards(spark, patterns, ignored, schema), schema, null_texts)


def read_shard_files(
    spark: SparkSession, files: Sequence[str], schema: T.StructType = TRIAL_SCHEMA, null_texts: Sequence[str] = NULL_TEXTS
) -> DataFrame:
    """Outcome shards of the files named, as ``read_shards`` reads those of a pattern."""
    if not files:
        return spark.createDataFrame([], schema)
    return _fitting(_parsed_files(spark, [as_plain(path) for path in files], (), schema), schema, null_texts)


def rejected_lines(
    spark: SparkSession,
    patterns: str | Sequence[str],
    ignored: Sequence[str] = (),
    schema: T.StructType = TRIAL_SCHEMA,
) -> DataFrame:
    """Lines that ``read_shards`` dropped, with the file they came from."""
    parsed = _parsed_shards(spark, patterns, ignored, schema)
    fits_not = F.col(CORRUPT).isNotNull() & _reads_all(schema)
    return parsed.filter(fits_not).select(SOURCE_FILE, F.col(CORRUPT).alias("line"))


def _reads_all(schema: T.StructType) -> Column:
    """Always true, but needs every column: Spark refuses to read the column of bad lines alone, as a count would."""
    return F.xxhash64(*schema.fieldNames()) >= F.lit(-(2**63))


def _fitting(parsed: DataFrame, schema: T.StructType, null_texts: Sequence[str]) -> DataFrame:
    fits = F.col(CORRUPT).isNull() & _reads_all(schema)
    return texts_to_null(parsed.filter(fits).select(*schema.fieldNames()), null_texts)


def _parsed_shards(
    spark: SparkSession, patterns: str | Sequence[str], ignored: Sequence[str], schema: T.StructType
) -> DataFrame:
    names = [patterns] if isinstance(patterns, str) else list(patterns)
    pattern = first_matching(spark, names, ignored)
    if pattern is None:
        raise FileNotFoundError(f"no outcome shards match any of {names}")
    return _parsed_files(spark, pattern, ignored, schema)


def _parsed_files(
    spark: SparkSession, pattern: str | list[str], ignored: Sequence[str], schema: T.StructType
) -> DataFrame:
    broken = _files_with_breaks(spark, pattern)
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for header, files in _by_header(spark, pattern, ignored).items():
        for path in files:
            groups.setdefault((header, _one_form(path) in broken), []).append(path)
    parts = [
        _shards_of_header(spark, pattern, header, schema, files if len(groups) > 1 else None, breaks)
        for (header, breaks), files in groups.items()
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.filter(~F.col(SOURCE_FILE).isin(*ignored)) if ignored else rows


def _one_form(path: str) -> str:
    """A local file is written file:///a or file:/a, depending on who writes it."""
    return re.sub("^file:/+", "file:/", path)


def _files_with_breaks(spark: SparkSession, pattern: str | list[str]) -> set[str]:
    """Files in which quoted texts go on over line breaks; only their names come back.

    A text that is opened in one line and closed in another leaves two lines with an odd number of quotes. Where
    the number of such lines is odd itself a quote was never closed: that is a bad line, and no break.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = spark.read.text(pattern).filter(F.col("value").contains('"') & (quotes % 2 == 1))
    counted = odd.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    return {_one_form(r.path) for r in counted.filter("n % 2 = 0").collect()}


def _by_header(spark: SparkSession, pattern: str | list[str], ignored: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the names in their header line; only that line of a file is read here."""
    files = sorted(path for path in spark.read.text(pattern).inputFiles() if base_name(path) not in set(ignored))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, line in first_lines(spark, files):
        header = tuple(name.strip() for name in next(csv.reader([line.lstrip("\ufeff")]), []))
        groups.setdefault(header, []).append(path)
    return groups


def _shards_of_header(
    spark: SparkSession,
    pattern: str | list[str],
    header: tuple[str, ...],
    schema: T.StructType,
    files: list[str] | None,
    breaks: bool,
) -> DataFrame:
    """``schema``, the text of a line that does not fit, and its file; of the files of one header, or of all.

    Files with ``breaks`` in their texts are read by one task each, the others split freely.
    """
    types = {f.name: f.dataType for f in schema.fields}
    named = [name for name in schema.fieldNames() if name in header]
    if not named or len(set(header)) < len(header):
        # No outcome shard, or one whose columns cannot be told apart: every line is a reject.
        own, text, options = [], "line", {"header": True, "sep": "\u0001", "quote": ""}
    else:
        text = CORRUPT
        own, options = [T.StructField(name, types.get(name, T.StringType())) for name in header], CSV
    rows = spark.read.schema(T.StructType([*own, T.StructField(text, T.StringType())])).options(**options)
    if own:
        rows = rows.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", breaks)
    rows = rows.csv(pattern)
    if files is not None:  # prunes the scan to these files
        forms = {form for path in files for form in (path, _one_form(path))}
        rows = rows.filter(F.col("_metadata.file_path").isin(*sorted(forms)))
    columns = [F.col(f"`{f.name}`") if f.name in named and own else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return rows.select(*columns, F.col(text).alias(CORRUPT), F.col("_metadata.file_name").alias(SOURCE_FILE))


# A document or line that does not parse is an error, never a row of nulls or no row at all.
_STRICT = {"mode": "FAILFAST"}


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = TASK_SCHEMA) -> DataFrame:
    """One JSON object per line: splits freely, so the form to prefer for large task sets. A broken line fails the query."""
    return spark.read.schema(schema).options(**_STRICT).json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = TASK_SCHEMA) -> DataFrame:
    """Documents that are a JSON array of objects; Spark reads each document in one task. A truncated one fails the query."""
    return spark.read.schema(schema).options(**_STRICT).option("multiLine", True).json(path)


def read_json_keyed(
    spark: SparkSession, path: str, schema: T.StructType = TASK_SCHEMA, id_col: str = "instance_id"
) -> DataFrame:
    """Documents that are one JSON object keyed by id; the key becomes ``id_col``.

    Each document is read in one task: keep such documents small, or many, or store JSON Lines. A truncated one fails the query.
    """
    fields = T.StructType([f for f in schema.fields if f.name != id_col])
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", T.MapType(T.StringType(), fields), _STRICT)).alias(id_col, "_task"))
        .select(id_col, "_task.*")
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_parquet_tree(spark: SparkSession, root: str, excluded: Sequence[str] = ("env",)) -> DataFrame:
    """Parquet files anywhere under ``root``, less those with an excluded text in their folder path.

    A single-hit search would depend on the listing order; this reads every hit.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    # A local file is written file:///a or file:/a, depending on who writes it.
    path, top = F.regexp_replace(path, "^file:/+", "file:/"), re.sub("^file:/+", "file:/", qualified(spark, root)).rstrip("/")
    below = F.lower(F.when(F.startswith(path, F.lit(top)), F.substring(path, len(top) + 1, 1 << 20)).otherwise(path))
    keep = F.lit(True)
    for text in excluded:
        keep = keep & ~F.contains(below, F.lit(text.lower()))
    return rows.filter(keep)


def as_tasks(df: DataFrame, schema: T.StructType = TASK_SCHEMA) -> DataFrame:
    """Task rows with the columns of ``schema`` first: the id is taken from the first id column there is, missing ones are null.

    All other columns pass through.
    """
    own = id_column(df)
    named = df if "instance_id" in df.columns else df.withColumnRenamed(own, "instance_id")
    first = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return named.select(*first, *[F.col(f"`{c}`") for c in named.columns if c not in schema.fieldNames()])


def _any_id(schema: T.StructType = TASK_SCHEMA) -> T.StructType:
    """``schema`` with every name that an id may have."""
    return T.StructType([*schema.fields, *[T.StructField(n, T.StringType()) for n in ID_COLUMNS if n not in schema.fieldNames()]])


def _id_of_any(df: DataFrame, schema: T.StructType = TASK_SCHEMA) -> DataFrame:
    found = F.coalesce(*[F.col(n) for n in ID_COLUMNS])
    return df.select(*[found.alias(n) if n == "instance_id" else F.col(n) for n in schema.fieldNames()])


def _csv_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Columns by the names in the header, as texts; the id under any of its names."""
    return as_tasks(spark.read.options(**CSV).options(multiLine=True, enforceSchema=False).csv(path))


_TASK_READERS = {
    "jsonl": lambda spark, path: _id_of_any(read_json_lines(spark, path, _any_id())),
    "json_array": lambda spark, path: _id_of_any(read_json_array(spark, path, _any_id())),
    "json_keyed": read_json_keyed,
    "parquet": lambda spark, path: as_tasks(read_parquet(spark, path)),
    "csv": _csv_tasks,
}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON task file in any of its three forms, told apart by how it starts; ids may have any of their names."""
    # A line may be a whole document: only its first character and whether it holds an id come back.
    line = F.ltrim("value")
    has_id = F.coalesce(*[F.get_json_object(line, f"$.{name}") for name in ID_COLUMNS]).isNotNull()
    head = spark.read.text(path).filter("trim(value) <> ''").select(F.substring(line, 1, 1).alias("start"), has_id.alias("has_id")).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    kind = "json_array" if head.start == "[" else "jsonl" if head.has_id else "json_keyed"
    return _TASK_READERS[kind](spark, path)


def read_tasks(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """Tasks from the first ``(format, path)`` that exists; an error where none does, never made-up rows.

    A source that exists but is broken fails the query: it does not hide a good one behind it as rows of nulls.
    """
    for kind, path in sources:
        if first_matching(spark, [path]) is not None:
            return read_json(spark, path) if kind == "json" else _TASK_READERS[kind](spark, path)
    raise FileNotFoundError(f"no task source exists: {[path for _, path in sources]}")


def id_column(df: DataFrame, candidates: Sequence[str] = ID_COLUMNS) -> str:
    """The first candidate that is a column, else the first column."""
    return next((name for name in candidates if name in df.columns), df.columns[0])


def with_task_id(df: DataFrame, id_col: str = "instance_id", prefix: str = "task_") -> DataFrame:
    """Add ids ``task_0, task_1, ..`` in row order where the id column is missing.

    Rows are stored once. Their place in a file is part of what Spark knows of a stored row, and the rows of each
    file stand in its footer: so numbering reads no column, sorts nothing and shuffles one row per file.
    """
    if id_col in df.columns:
        return df
    stored = stored_table(df).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = stored.groupBy("_file").agg(F.count("*").alias("_size"))
    # Files are named by the partition that wrote them, and by their turn where it wrote several. One row per file.
    place = [F.regexp_extract("_file", r"^part-([0-9]+)-.*-c([0-9]+)", n).cast("int") for n in (1, 2)]
    earlier = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    starts = stored_table(sizes.select("_file", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")))
    return stored.join(starts, "_file").select(
        F.concat(F.lit(prefix), (F.col("_start") + F.col("_row")).cast("string")).alias(id_col), *df.columns
    )


def table_profile(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns, and the column names."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )
