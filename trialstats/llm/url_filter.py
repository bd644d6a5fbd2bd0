"""URL filters: dated list entries as validity intervals, and an as-of join of captures with them.

An entry puts a key on the list or takes it off, from its date until the key's next entry. Entries and captures
are sorted together by key and time into ranges of even size, and the last entry is carried from range to
range. So a host with a third of all captures is spread over ranges, and no capture meets more than one entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.session import stored_table

_CHUNK = "_chunk"


def host_of(url: Column) -> Column:
    """The lower-case host without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def steps_of(url: Column) -> Column:
    """The steps of the path in order, without empty ones."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda step: step != "")


def _domains_of(host: Column) -> Column:
    """The host and each domain above it of two labels or more; none for an empty host."""
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tails)


def _paths_of(url: Column, deepest: int) -> Column:
    """The first 1, 2, .. up to ``deepest`` steps of the path."""
    steps = steps_of(url)
    reach = F.least(F.size(steps), F.lit(deepest))
    paths = F.transform(F.sequence(F.lit(1), F.greatest(reach, F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    return F.when(reach < 1, F.array().cast("array<string>")).otherwise(paths)


def keys_of(urls: DataFrame, url: Column, deepest: int, name: str = "_keys") -> DataFrame:
    """Add what a list may hold about a URL: its host, each domain above it of two labels or more, and any of them
    with the first steps of the path, up to ``deepest``.
    """
    # Columns of their own first: inside the function over domains the paths would be made again for each domain.
    parts = urls.withColumns({"_domains": _domains_of(host_of(url)), "_paths": _paths_of(url, deepest)})
    under = F.transform("_domains", lambda d: F.transform("_paths", lambda p: F.concat(d, F.lit("/"), p)))
    return parts.withColumn(name, F.array_distinct(F.concat("_domains", F.flatten(under)))).drop("_domains", "_paths")


def _cleaned(entries: DataFrame) -> DataFrame:
    """Entries without slashes at the end of their keys."""
    return entries.withColumn("key", F.regexp_replace("key", "/+$", ""))


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Sorted into ranges that are stored; ``_chunk`` numbers them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("int")
    return stored_table(rows.repartitionByRange(parts, *order)).select("*", number.alias(_CHUNK))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, valid_from, valid_to, listed``: what held for a key from each of its dates to the next.

    ``entries`` holds ``key, ts, listed``. Of several entries of a key at one time, one that lists it wins. Entries
    without key or time are left out; ``valid_to`` is null for the last.
    """
    at = entries.filter("key IS NOT NULL AND ts IS NOT NULL").groupBy("key", "ts").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    ranged = _ranged(at, "key", "ts")
    inside = Window.partitionBy("key", _CHUNK).orderBy("ts")
    firsts = ranged.groupBy("key", _CHUNK).agg(F.min("ts").alias("_first"))
    later = Window.partitionBy("key").orderBy(_CHUNK)  # one row per range at most
    firsts = firsts.select("key", _CHUNK, F.lead("_first").over(later).alias("_next"))
    rows = ranged.withColumn("_lead", F.lead("ts").over(inside)).join(stored_table(firsts), ["key", _CHUNK])
    return rows.select("key", F.col("ts").alias("valid_from"), F.coalesce("_lead", "_next").alias("valid_to"), "listed")


def as_of(captures: DataFrame, periods: DataFrame) -> DataFrame:
    """``row_no, key, valid_from, valid_to, listed``: for each key of a capture, the period its time falls in, if any.

    ``captures`` holds ``row_no, key, ts``.
    """
    period = F.struct("valid_from", "valid_to", "listed")
    asked = captures.select("key", "ts", F.lit(1).alias("asks"), "row_no", F.lit(None).cast(periods.select(period.alias("p")).schema["p"].dataType).alias("period"))
    given = periods.select("key", F.col("valid_from").alias("ts"), F.lit(0).alias("asks"), F.lit(-1).cast("bigint").alias("row_no"), period.alias("period"))
    ranged = _ranged(asked.unionByName(given), "key", "ts", "asks", "row_no")
    so_far = Window.partitionBy("key", _CHUNK).orderBy("ts", "asks", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy("key", _CHUNK).agg(F.max("period").alias("_end"))
    before = Window.partitionBy("key").orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row per range at most
    ends = stored_table(ends.select("key", _CHUNK, F.last("_end", ignorenulls=True).over(before).alias("_carried")))
    rows = ranged.withColumn("_last", F.last("period", ignorenulls=True).over(so_far)).filter("asks = 1").join(ends, ["key", _CHUNK])
    return rows.select("row_no", "key", F.coalesce("_last", "_carried").alias("_p")).filter("_p IS NOT NULL").select("row_no", "key", "_p.*")


def filtered(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per row of ``captures``: ``id, host, fetched_at, n_listed, rule, valid_from, valid_to, blocked``.

    An entry names a host or a domain above it in lower case, alone or with the first steps of a path; slashes at its end
    do not count, nor do empty steps, queries and fragments of a URL.
    A capture is blocked if any of its keys was listed when it was fetched; ``rule`` is the longest such key, of several the greatest. A null or
    odd URL has an empty host and no keys, a null time meets no entry: neither is blocked. Repeated rows are
    judged each. An empty list blocks nothing; an empty table gives no rows.
    """
    entries = _cleaned(entries)
    # One number: no key of the list goes deeper, so no longer path of a capture can be on it.
    deepest = entries.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    numbered = captures.select(
        F.col(id_col).alias("id"), F.col(time_col).alias("fetched_at"), F.col(url_col).alias("_url"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    keyed = keys_of(numbered.withColumn("host", host_of(F.col("_url"))), F.col("_url"), deepest)
    rows = stored_table(keyed.drop("_url"))
    periods = stored_table(intervals(entries))
    listed = stored_table(periods.select("key").distinct())
    asked = rows.filter("fetched_at IS NOT NULL").select("row_no", F.explode("_keys").alias("key"), F.col("fetched_at").alias("ts"))
    asked = asked.join(listed, "key", "left_semi")
    active = as_of(asked, periods).filter("listed")
    longest = F.max(F.struct(F.char_length("key"), F.col("key").alias("rule"), "valid_from", "valid_to"))
    active = active.groupBy("row_no").agg(F.count("*").alias("n_listed"), longest.alias("_r"))
    out = rows.join(stored_table(active), "row_no", "left")
    return out.select(
        "id", "host", "fetched_at", F.coalesce("n_listed", F.lit(0)).alias("n_listed"), F.col("_r.rule").alias("rule"),
        F.col("_r.valid_from").alias("valid_from"), F.col("_r.valid_to").alias("valid_to"), F.col("n_listed").isNotNull().alias("blocked"),
    )
