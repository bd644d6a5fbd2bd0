"""Repeated lines: documents that share rare lines are aligned, and common blocks go from the later one.

Each shared line leads from a document to the first that holds the line, so the pairs grow with the lines and not
with the square of a group. A line counts as rare if few documents hold it, or if it is about as rare as
any that its document shares: copies that come in thousands are found by their own lines. What the rare lines
leave is found by the common ones: those that no alignment has covered lead to their first document as well, so
a notice goes from a third of all documents as it goes from three. A pair is aligned by patience diff: lines that
occur once in either are matched by a longest increasing run, and what lies between is aligned in turn; where no line
occurs once in both, its first meets the first, its second the second.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import join_same, whole_text, with_keys
from trialstats.session import stored_table

RARE = 64
# Characters of the least block that is deleted, and of the least line that pairs documents.
BLOCK_CHARS = 80
LINE_CHARS = 20


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def rising(values: list[int]) -> list[int]:
    """Places of a longest increasing run."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _numbered(lines) -> list[tuple]:
    seen: Counter = Counter()
    out = []
    for v in lines:
        out.append((v, seen[v]))
        seen[v] += 1
    return out


def patience(a, b) -> list[tuple[int, int]]:
    """Aligned places of two sequences, in order."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ii, j, jj = todo.pop()
        while i < ii and j < jj and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < ii and j < jj and a[ii - 1] == b[jj - 1]:
            ii, jj = ii - 1, jj - 1
            found.append((ii, jj))
        if i == ii or j == jj:
            continue
        here, there = Counter(a[i:ii]), Counter(b[j:jj])
        place = {v: j + k for k, v in enumerate(b[j:jj]) if there[v] == 1}
        once = [(i + k, place[v]) for k, v in enumerate(a[i:ii]) if here[v] == 1 and v in place]
        if not once:  # the k-th of a line here meets the k-th there
            place = {v: j + k for k, v in enumerate(_numbered(b[j:jj]))}
            once = [(i + k, place[v]) for k, v in enumerate(_numbered(a[i:ii])) if v in place]
        anchors = [once[k] for k in rising([y for _, y in once])]
        if not anchors:
            continue
        found += anchors
        x, y = i, j
        for p, q in [*anchors, (ii, jj)]:
            todo.append((x, p, y, q))
            x, y = p + 1, q + 1
    return sorted(found)


def common_blocks(later, earlier, chars, least: int = BLOCK_CHARS) -> list[int]:
    """Lines of ``later`` in runs that stand in ``earlier`` as they are, of ``least`` characters or more."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(int(chars[k]) for k in run) >= least:
                out += run
            run = []
        run.append(i)
        last = (i, j)
    return out


def _align(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = [
                common_blocks(later.tolist(), earlier.tolist(), chars, least)
                for later, earlier, chars in zip(batch["later"], batch["earlier"], batch["chars"], strict=True)
            ]
            yield pd.DataFrame({"row_no": batch["row_no"], "ref_id": batch["ref_id"], "cut": cut})

    return run


def _aligned(pairs: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """``row_no, ref_id, cut`` of the pairs that have a common block."""
    pairs = pairs.join(rows.select("row_no", F.col("lines").alias("later"), "chars"), "row_no")
    pairs = pairs.join(rows.select(F.col("row_no").alias("ref_no"), F.col("lines").alias("earlier")), "ref_no")
    pairs = pairs.select("row_no", "ref_id", "later", "earlier", "chars")
    return stored_table(pairs.mapInPandas(_align(least), "row_no bigint, ref_id bigint, cut array<int>").filter("size(cut) > 0"))


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, least: int = BLOCK_CHARS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, n_lines, cut, refs``.

    ``cut`` are the places of lines, from 0, that stand in an earlier document as well, ``refs`` the ids of those
    documents. Earlier is by id, nulls last; of rows with the same id, by their order in the table. White space at
    the ends of a line does not count; empty lines go with a block but never make one. A null text is empty
    and has one empty line. An empty table gives no rows.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row_no"),
        F.transform(lines_of(text), _bare).alias("_l"),
    )
    rows = stored_table(
        rows.select(
            "doc_id", "text_hash", "row_no", F.transform("_l", lambda x: F.xxhash64(x)).alias("lines"),
            F.transform("_l", lambda x: F.char_length(x)).alias("chars"),
        )
    )
    worth = F.filter(F.arrays_zip("lines", "chars"), lambda z: z["chars"] >= LINE_CHARS)
    held = rows.select("doc_id", "row_no", F.explode(F.array_distinct(F.transform(worth, lambda z: z["lines"]))).alias("line"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no"))
    counts = held.groupBy("line").agg(F.count("*").alias("n"), first.alias("_f")).filter("n > 1")
    shared = stored_table(counts.select("line", "n", F.col("_f.row_no").alias("ref_no"), F.col("_f.doc_id").alias("ref_id")))
    links = stored_table(held.join(shared, "line").filter("row_no <> ref_no").select("row_no", "ref_no", "ref_id", "line", "n"))
    rarest = stored_table(links.groupBy("row_no").agg(F.min("n").alias("least")))
    is_rare = F.col("n") <= F.greatest(F.lit(rare), 2 * F.col("least"))
    links = stored_table(links.join(rarest, "row_no").select("row_no", "ref_no", "ref_id", "line", is_rare.alias("is_rare")))
    by_rare = stored_table(links.filter("is_rare").select("row_no", "ref_no", "ref_id").distinct())
    cuts = _aligned(by_rare, rows, least)
    # Common lines that still stand, each once more for what no rare line has led to.
    gone = rows.join(cuts, "row_no").select("row_no", F.explode(F.transform("cut", lambda i: F.element_at("lines", i + 1))).alias("line"))
    rest = links.filter("NOT is_rare").join(stored_table(gone.distinct()), ["row_no", "line"], "left_anti")
    rest = rest.select("row_no", "ref_no", "ref_id").distinct().join(by_rare, ["row_no", "ref_no"], "left_anti")
    cuts = cuts.unionByName(_aligned(stored_table(rest), rows, least))
    # What one text may hold meets in one group.
    cuts = cuts.groupBy("row_no").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"), F.array_sort(F.collect_set("ref_id")).alias("refs")
    )
    out = rows.select("row_no", "doc_id", "text_hash", F.size("lines").cast("bigint").alias("n_lines")).join(stored_table(cuts), "row_no", "left")
    return out.select(
        "doc_id", "text_hash", "n_lines", F.coalesce("cut", F.array().cast("array<int>")).alias("cut"),
        F.coalesce("refs", F.array().cast("array<bigint>")).alias("refs"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts. Rows that repeat id and text all lose what one of them loses."""
    found = repeated_lines(docs, id_col, text_col, **options)
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "cut").filter("size(cut) > 0").dropDuplicates(["_id", "_hash"])
    rows = with_keys(docs, _id=F.col(id_col), _hash=F.xxhash64(whole_text(text_col)))
    rows = join_same(rows, found.withColumnRenamed("cut", "_cut"), ["_id", "_hash"], "left")
    text = F.col(f"_row.`{text_col}`")
    kept = F.filter(lines_of(text), lambda x, i: ~F.array_contains("_cut", i))
    text = F.when(F.col("_cut").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return rows.select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
