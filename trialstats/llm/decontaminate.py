"""Benchmark passages in documents: a prefix-filtered join on the rarest word of every window.

A window (``WINDOW`` consecutive words of an item, or a shorter item whole) occurs only where all its words
do, so it is enough to look for one: its rarest in the corpus. Where that word stands, its place in the
window tells where the window would have to lie; what does not fit into the document is left out, and the
rest is compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import ascii_lower, join_same, whole_text, with_keys, without_keys
from trialstats.session import stored_table

WINDOW = 13
# A document is contaminated if one word in so many, or more, is hit.
SHARE = 20
_KEYS = ["_id0", "_key"]


def words(text: Column) -> Column:
    """Lower-case words: runs of digits, letters and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``win_id, win``, and ``win_id, item_id`` for the items that hold them."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words(whole_text(text_col)).alias("_w")
    ).filter("size(_w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (window - 1), F.lit(1)))
    found = items.select("item_id", "_w", F.explode(starts).alias("_at"))
    found = stored_table(found.select("item_id", F.slice("_w", F.col("_at"), F.lit(window)).alias("win")).distinct())
    windows = stored_table(found.select("win").distinct().select(F.monotonically_increasing_id().alias("win_id"), "win"))
    return windows, stored_table(found.join(windows, "win").select("win_id", "item_id"))


def anchored(windows: DataFrame, docs_words: DataFrame) -> DataFrame:
    """``anchor, win_id, win, off``: each window under its rarest word. Windows with a word that no document has are gone."""
    parts = windows.select("win_id", F.posexplode("win").alias("off", "word"))
    vocabulary = stored_table(parts.select("word").distinct())
    # Counted over all documents, combined before the shuffle.
    counts = docs_words.select(F.explode("_w").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = parts.join(stored_table(counts), "word", "left")
    rarest = ranked.groupBy("win_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")).alias("_r")
    )
    rarest = rarest.filter("_r.n > 0").select("win_id", F.col("_r.word").alias("anchor"), F.col("_r.off").alias("off"))
    return stored_table(rarest.join(windows, "win_id"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, n_words, n_hit, items, contaminated``.

    ``n_hit`` counts words inside any occurrence of a window, ``items`` the sorted ids (texts) of items with
    one. A null text has no words; a null item id is the empty text; an item of several rows is hit by any of
    them. Rows are told apart by id and text, so rows that repeat both get the same result each. An
    empty benchmark hits nothing; an empty table gives no rows.
    """
    text = whole_text(text_col)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col), F.lit(0)).alias("_id0"),
        F.xxhash64(F.col(id_col), text).alias("_key"),
        F.xxhash64(text).alias("text_hash"),
        words(text).alias("_w"),
    )
    windows, holders = item_windows(benchmark, item_col, item_text_col, window)
    anchors = anchored(windows, keyed)
    places = keyed.select(*_KEYS, F.size("_w").alias("n"), F.posexplode("_w").alias("at", "word"))
    start = F.col("at") - F.col("off")
    fits = (F.col("word") == F.col("anchor")) & (start >= 0) & (start + F.size("win") <= F.col("n"))
    candidates = places.join(anchors, fits).select(*_KEYS, F.struct(start.alias("start"), "win_id", "win").alias("c"))
    # One group is what one text may hold.
    candidates = stored_table(candidates.groupBy(*_KEYS).agg(F.collect_list("c").alias("_c")))

    whole = keyed.join(candidates, _KEYS, "left")
    equal = F.filter("_c", lambda c: F.slice(F.col("_w"), c["start"] + 1, F.size(c["win"])) == c["win"])
    whole = whole.select("doc_id", "text_hash", *_KEYS, F.size("_w").cast("bigint").alias("n_words"), F.coalesce(equal, F.array()).alias("_c"))
    inside = F.array_distinct(F.flatten(F.transform("_c", lambda c: F.sequence(c["start"], c["start"] + F.size(c["win"]) - 1))))
    hit = stored_table(
        whole.select(
            "doc_id", "text_hash", *_KEYS, "n_words", F.size(inside).cast("bigint").alias("n_hit"),
            F.array_distinct(F.transform("_c", lambda c: c["win_id"])).alias("_wins"),
        )
    )
    held = hit.select(*_KEYS, F.explode("_wins").alias("win_id")).join(holders, "win_id").groupBy(*_KEYS)
    held = held.agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = join_same(hit, held, _KEYS, "left")
    return out.select(
        "doc_id", "text_hash", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns. Null ids are told apart by text."""
    lost = contamination(docs, benchmark, id_col, text_col).filter("contaminated")
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = with_keys(docs, _id=F.col(id_col), _hash=F.xxhash64(whole_text(text_col)))
    return without_keys(join_same(rows, lost, ["_id", "_hash"], "left_anti"))
