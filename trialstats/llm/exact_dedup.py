"""Exact duplicates, with frequent digests handled apart.

A Misra-Gries sketch finds every digest with more than one in ``counters`` + 1 of all rows. Those few are
counted exactly, and their verified winners, at most ``counters`` rows, are broadcast, so their copies are
decided where they lie. All other digests are shuffled; none of them can be large.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import join_same, whole_text, with_keys, without_keys
from trialstats.session import stored_table

# Frequent digests that are kept: bounds what is broadcast, whatever the table.
COUNTERS = 256


def text_digest(text_col: str = "text") -> Column:
    """SHA-256 of the text with every run of white space made one space; null counts as empty."""
    normal = F.regexp_replace(whole_text(text_col), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(normal, 256))


def merged(counters: Counter, k: int) -> Counter:
    """Misra-Gries: no more than ``k`` counters; each is lowered by the largest count that is left out."""
    if len(counters) <= k:
        return counters
    cut = sorted(counters.values(), reverse=True)[k]
    return Counter({digest: n - cut for digest, n in counters.items() if n > cut})


def _sketches(k: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: Counter = Counter()
        for batch in batches:
            counters.update(Counter(batch["digest"]))
            counters = merged(counters, k)
        yield pd.DataFrame({"digest": list(counters), "n": list(counters.values())})

    return sketch


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them every one with more than ``1 / (counters + 1)`` of the rows."""
    sketches = rows.select("digest").mapInPandas(_sketches(counters), "digest binary, n bigint")
    # One sum per digest that any sketch kept; the merge then needs the largest of these sums only.
    sums = sketches.groupBy("digest").agg(F.sum("n").alias("n"))
    largest = sums.orderBy(F.desc("n"), "digest").limit(counters + 1).collect()
    kept = merged(Counter({bytes(r.digest): r.n for r in largest}), counters)
    return rows.sparkSession.createDataFrame([(bytearray(d),) for d in sorted(kept)], "digest binary")


def _winners(rows: DataFrame) -> DataFrame:
    # Nulls last: an id that is missing is never smaller than one that is there.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no"))
    return (
        rows.groupBy("digest")
        .agg(first.alias("_first"), F.count("*").alias("group_size"))
        .select("digest", F.col("_first.doc_id").alias("keep_id"), F.col("_first.row_no").alias("_keep_no"), "group_size")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, digest, keep_id, group_size, kept``.

    Of equal texts the row with the smallest id is kept. A null text is the empty text; a null id is larger
    than any other. Of rows that repeat both id and text one is kept. An empty table gives no rows; other
    columns are not looked at.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), text_digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row_no")
    )
    slim = stored_table(slim)  # texts are read and hashed once, and row numbers stay what they are
    frequent = F.broadcast(frequent_digests(slim, counters))
    hot = slim.join(frequent, "digest", "left_semi")
    rest = slim.join(frequent, "digest", "left_anti")
    decided = hot.join(F.broadcast(_winners(hot)), "digest").unionByName(rest.join(_winners(rest), "digest"))
    return decided.select(
        "doc_id", "digest", "keep_id", "group_size", (F.col("row_no") == F.col("_keep_no")).alias("kept")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns."""
    groups = stored_table(exact_groups(docs, id_col, text_col).withColumnRenamed("doc_id", "_id").withColumnRenamed("digest", "_digest"))
    rows = with_keys(docs, _id=F.col(id_col), _digest=text_digest(text_col))
    keys = ["_id", "_digest"]
    lost = groups.filter(~F.col("kept") & ~F.col("_id").eqNullSafe(F.col("keep_id"))).select(*keys)
    out = join_same(rows, lost, keys, "left_anti")
    # Left over are rows that repeat the id and the text of a kept one; there are none in a table with a key.
    twice = groups.filter(~F.col("kept") & F.col("_id").eqNullSafe(F.col("keep_id"))).select(*keys).distinct()
    if not twice.isEmpty():
        again = join_same(rows, twice, keys, "left_semi").dropDuplicates(keys)
        out = join_same(out, twice, keys, "left_anti").unionByName(again)
    return without_keys(out)
