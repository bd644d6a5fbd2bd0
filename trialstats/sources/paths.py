"""Path questions put to the Hadoop file system, so they hold on any shared storage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


# Bytes that a header line may have, and files opened at once.
HEADER_BYTES = 1 << 16
OPENED = 16


def base_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def first_lines(spark: SparkSession, files: Sequence[str]) -> list[tuple[str, str]]:
    """Each file, and its first line that is not empty; one of ``HEADER_BYTES`` or more is an error. ``files`` are URIs."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(uri: str) -> tuple[str, str]:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(uri))
        opened = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            plain = opened if codec is None else codec.createInputStream(opened)
            bounded = jvm.org.apache.commons.io.input.BoundedInputStream(plain, HEADER_BYTES)
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(bounded, "UTF-8"))
            line = lines.readLine()
            while line is not None and not line.strip():
                line = lines.readLine()
            if line is not None and len(line.encode()) > HEADER_BYTES - 4:
                raise ValueError(f"the header of {uri} is longer than {HEADER_BYTES} bytes")
            return uri, line or ""
        finally:
            opened.close()

    with ThreadPoolExecutor(OPENED) as pool:
        return list(pool.map(first_line, files))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in name order; empty where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in (found or []))


def first_matching(spark: SparkSession, patterns: Sequence[str], ignored: Sequence[str] = ()) -> str | None:
    """The first pattern with at least one file that is not ignored by base name.

    Patterns are alternatives, never united: newer shards shadow older ones.
    """
    dropped = set(ignored)
    for pattern in patterns:
        if any(base_name(path) not in dropped for path in matching(spark, pattern)):
            return pattern
    return None


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path of ``path``, and its file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority, as files are listed."""
    plain, system = _file_system(spark, path)
    return system.makeQualified(plain).toString()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file whole, or nothing where it is absent."""
    file, system = _file_system(spark, path)
    if not system.exists(file):
        return None
    opened = system.open(file)
    try:
        return bytes(opened.readAllBytes()).decode()
    finally:
        opened.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file in one step: a reader sees the old text or the new one, never a part or nothing."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file, system = _file_system(spark, path)
    new, _ = _file_system(spark, f"{path}-{uuid.uuid4().hex}")
    written = system.create(new, True)
    written.write(bytearray(text.encode()))
    written.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(kinds, 1)
    overwrite[0] = kinds.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(file.toUri(), conf).rename(new, file, overwrite)


def delete(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete folders of one's own, with all that is in them."""
    for path in paths:
        folder, system = _file_system(spark, path)
        system.delete(folder, True)


def as_plain(path: str) -> str:
    """A path in which no character stands for others, for readers that take patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)
