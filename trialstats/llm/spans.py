"""Where a pattern matches, as code point spans, with built-in functions only.

``split`` gives the pieces between matches and ``regexp_extract_all`` the matches themselves; running sums of
their lengths are the offsets. Patterns must not match the empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths that are summed as one block: the sums of blocks are then summed in turn, so that the work stays
# near linear for texts with very many matches.
BLOCK = 256


def _running(lengths: Column) -> Column:
    """``total`` and ``before`` (what precedes each) of a short array of lengths."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(
        lengths,
        start,
        lambda acc, n: F.struct(
            (acc["total"] + n).alias("total"), F.array_append(acc["before"], acc["total"]).alias("before")
        ),
    )


def offsets(lengths: Column) -> Column:
    """The sum of all lengths before each, for a non-empty array."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK))
    )
    sums = F.transform(blocks, _running)
    bases = _running(F.transform(sums, lambda s: s["total"]))["before"]
    return F.flatten(F.zip_with(sums, bases, lambda s, base: F.transform(s["before"], lambda b: b + base)))


def spans(text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """``start, rank, end, kind, match`` of every match of ``pattern``, leftmost and not overlapping; ``keep`` drops some."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    # Every match follows its piece; the last piece has no match.
    lengths = F.zip_with(pieces, matches, lambda p, m: F.char_length(p) + F.coalesce(F.char_length(m), F.lit(0)))
    found = F.zip_with(
        F.zip_with(pieces, offsets(lengths), lambda p, at: F.char_length(p) + at),
        matches,
        lambda start, m: F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + F.char_length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("match")
        ),
    )
    found = F.filter(found, lambda s: s["match"].isNotNull() & (keep(s["match"]) if keep else F.lit(True)))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(empty())


def empty() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,match:string>>")


def in_order(*found: Column) -> Column:
    """All spans by start, then by the rank of their kind."""
    return F.array_sort(F.concat(*found))


def written(found: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")
