"""Exact tails of the signed-rank sum for groups of any number of pairs.

The chances of all sums are the coefficients of a product: each pair gives ``(1 + x^r) / 2``, where r is its doubled rank, and m tied
pairs the m-th power of that. The product is taken up a tree: every node multiplies the polynomials of two
others, and a polynomial lies in rows of ``BLOCK`` coefficients, so a product is a job over pairs of rows, each a
convolution by FFT, and no task holds a whole polynomial.

An FFT is exact to about 1e-16 of the largest coefficient, and a tail may be far smaller. So each group is tilted first:
a rank counts as positive with the chance ``1 / (1 + exp(-t r))``, with t such that the sum seen is about the mean. The tail is then
about a half, and is scaled back at the end: its digits are right however small it is. Rows whose coefficients
add up to less than 1e-20 are left out, which changes no digit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.session import stored_table

# Coefficients of a row, and of the product of a leaf before its ends are trimmed.
BLOCK = 1 << 20
LEAF_SIZE = 1 << 24

# Coefficients that add up to less than this change no digit of a tail of about a half.
_NOTHING = 1e-20
# Pairs that are multiplied one by one before FFTs take over.
_FEW = 64
_STEPS = 64

# Coefficients travel as the bytes of doubles: nothing between tasks looks at them one by one.
_NODE = "g string, node bigint, block bigint, c binary"


def _tilts(ranks: DataFrame, sums: DataFrame) -> DataFrame:
    """``g, w2, tilt``: the tilt whose mean is nearest to the sum seen; 0 where the sum is not above the mean.

    Two passes over the ranks, each with the means at a row of tilts: the second between the neighbours of the best of the first.
    """
    aims = sums.select("g", "w2", F.lit(-30.0).alias("low"), F.lit(2.0).alias("high"))
    for _ in range(2):
        at = [F.exp(F.col("low") + (F.col("high") - F.col("low")) * (i / (_STEPS - 1))) for i in range(_STEPS)]
        rows = ranks.join(aims, "g")
        means = [F.sum(F.col("m") * F.col("r") / (1 + F.exp(-t * F.col("r")))) for t in at]
        found = rows.groupBy("g", "w2", "low", "high").agg(F.array(*means).alias("means"), F.sum(F.col("m") * F.col("r") / 2).alias("middle"))
        gaps = F.transform("means", lambda x: F.abs(x - F.col("w2")))
        best = F.array_position(gaps, F.array_min(gaps)) - 1
        step = (F.col("high") - F.col("low")) / (_STEPS - 1)
        found = found.withColumn("best", F.col("low") + step * best)
        aims = stored_table(found.select("g", "w2", (F.col("best") - step).alias("low"), (F.col("best") + step).alias("high"), "best", "middle"))
    return aims.select("g", "w2", F.when(F.col("w2") > F.col("middle"), F.exp("best")).otherwise(0.0).alias("tilt"))


def _rows(g: str, node: int, first: int, c: np.ndarray, size: int) -> Iterator[tuple]:
    """The rows of ``size`` coefficients of a polynomial whose first coefficient is that of ``x^first``."""
    for block in range(first // size, (first + len(c) - 1) // size + 1):
        low, high = max(block * size, first), min((block + 1) * size, first + len(c))
        part = c[low - first : high - first]
        if part.sum() > _NOTHING:
            row = np.zeros(high - block * size)
            row[low - block * size : high - block * size] = part
            yield g, node, block, row.tobytes()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _NODE.split(", ")])


def _fast_size(n: int) -> int:
    """The least size from ``n`` on that is a power of two, or 3, 5 or 9 times one: FFTs of these are fast."""
    return min(k << max(0, -(-n // k) - 1).bit_length() for k in (1, 3, 5, 9))


def _convolved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = len(a) + len(b) - 1
    size = _fast_size(n)
    return np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n], 0.0)


def _trimmed(first: int, c: np.ndarray) -> tuple[int, np.ndarray]:
    """The polynomial without the ends that add up to nothing."""
    low, high = int(np.searchsorted(np.cumsum(c), _NOTHING)), int(np.searchsorted(np.cumsum(c[::-1]), _NOTHING))
    return first + low, c[low : len(c) - high]


def _leaf(rows: list) -> tuple[int, np.ndarray]:
    """The product of a node's pairs, and its first exponent."""
    pairs = [(row.r, 1 / (1 + np.exp(-row.tilt * row.r))) for row in rows for _ in range(row.m)]
    level = []
    for at in range(0, len(pairs), _FEW):
        c = np.ones(1)
        for r, chance in pairs[at : at + _FEW]:
            grown = np.zeros(len(c) + r)
            grown[: len(c)] = c * (1 - chance)
            grown[r:] += c * chance
            c = grown
        level.append(_trimmed(0, c))
    while len(level) > 1:
        both = [_trimmed(i + j, _convolved(a, b)) for (i, a), (j, b) in zip(level[::2], level[1::2], strict=False)]
        level = both + level[2 * len(both) :]
    return level[0]


def _held(batches: Iterator[pd.DataFrame], key: Callable, made: Callable) -> Iterator[pd.DataFrame]:
    """Rows of one key after another, which come in order: what ``made`` makes of each."""
    held: list = []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if held and key(held[0]) != key(row):
                yield made(held)
                held = []
            held.append(row)
    if held:
        yield made(held)


def _leaf_rows(size: int):
    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _held(batches, lambda r: (r.g, r.node), lambda rows: _frame(list(_rows(rows[0].g, rows[0].node, *_leaf(rows), size))))

    return leaves


def _product_rows(size: int):
    """Convolutions of two rows each; they fill two rows of the product."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                c = _convolved(np.frombuffer(r.a), np.frombuffer(r.b))
                yield _frame(list(_rows(r.g, r.node, (r.block_a + r.block_b) * size, c, size)))

    return products


def _sum_rows(size: int):
    """Rows of one place added up, one held at a time."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, np.empty(0)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if key != (r.g, r.node, r.block):
                    if key is not None:
                        out.append((*key, total.tobytes()))
                    key, total = (r.g, r.node, r.block), np.zeros(size)
                part = np.frombuffer(r.c)
                total[: len(part)] += part
            yield _frame(out)
        if key is not None:
            yield _frame([(*key, total.tobytes())])

    return sums


def _product(ranks: DataFrame, most_pairs: int, largest_rank: int, size: int, leaf_size: int) -> DataFrame:
    """``g, block, c`` of the product over all pairs of a group; ``ranks`` has g, r, m, before and tilt."""
    leaf = max(1, leaf_size // largest_rank)
    # Tied pairs are dealt to as many leaves as they need.
    first, last = F.floor(F.col("before") / leaf), F.floor((F.col("before") + F.col("m") - 1) / leaf)
    dealt = ranks.select("*", F.explode(F.sequence(first, last)).alias("node"))
    inside = F.least(F.col("before") + F.col("m"), (F.col("node") + 1) * leaf) - F.greatest(F.col("before"), F.col("node") * leaf)
    # Told how many tasks: the rows are few and small, what is made of them is not.
    tasks = int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("g", "node", "r", inside.alias("m"), "tilt").repartition(tasks, "g", "node").sortWithinPartitions("g", "node", "r")
    nodes = stored_table(dealt.mapInPandas(_leaf_rows(size), _NODE))
    width = -(-most_pairs // leaf)
    while width > 1:
        above = F.expr("node div 2")
        a = nodes.filter("node % 2 = 0").select("g", above.alias("node"), F.col("block").alias("block_a"), F.col("c").alias("a"))
        b = nodes.filter("node % 2 = 1").select("g", above.alias("node"), F.col("block").alias("block_b"), F.col("c").alias("b"))
        # Dealt by the pair of rows, not by the group: one large group fills all tasks.
        pairs = a.join(b, ["g", "node"]).repartition(tasks, "g", "node", "block_a", "block_b")
        alone = a.join(b, ["g", "node"], "left_anti").select("g", "node", F.col("block_a").alias("block"), F.col("a").alias("c"))
        parts = pairs.mapInPandas(_product_rows(size), _NODE).repartition("g", "node", "block").sortWithinPartitions("g", "node", "block")
        nodes = stored_table(parts.mapInPandas(_sum_rows(size), _NODE).unionByName(alone))
        width = -(-width // 2)
    return nodes.drop("node")


def _tail_rows(size: int):
    """What each row adds to the tilted tail, its coefficients scaled back relative to the sum seen."""

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                c = np.frombuffer(r.c)
                beyond = np.arange(len(c)) + (r.block * size - r.w2)
                out.append((r.g, float((c * np.exp(-r.tilt * np.maximum(beyond, 0)))[beyond >= 0].sum())))
            yield pd.DataFrame(out, columns=["g", "part"])

    return tails


def exact_tails(
    ranks: DataFrame, sums: DataFrame, keys: Sequence[str], block: int = BLOCK, leaf_size: int = LEAF_SIZE
) -> DataFrame:
    """``keys, p_exact``: the chance that the doubled sum of positive ranks is at least ``w2``, for each group.

    ``ranks`` has the keys, a doubled rank ``r``, its number of pairs ``m``, and the number of pairs ``before`` it; ``sums`` the keys and ``w2``.
    Keys may be null. Any number of pairs: the work grows with the square of a group's pairs, and is
    spread over rows. An empty table gives no rows.
    """
    g = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys])).alias("g")
    ranks = stored_table(ranks.select(g, F.col("r").cast("bigint").alias("r"), F.col("m").cast("bigint").alias("m"), F.col("before").cast("bigint").alias("before")))
    size = ranks.agg(F.max(F.col("before") + F.col("m")), F.max("r")).first()
    groups = sums.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("keys"), g, F.col("w2").cast("bigint").alias("w2"))
    if size[0] is None:
        return groups.select("keys.*", F.lit(None).cast("double").alias("p_exact")).limit(0)
    tilts = stored_table(_tilts(ranks, groups.select("g", "w2")))
    tilted = ranks.join(tilts.select("g", "tilt"), "g")
    # The logarithm of what the tilt took out of the chances of all ranks.
    scale = tilted.groupBy("g").agg(F.sum(F.col("m") * (F.log1p(F.exp(-F.col("tilt") * F.col("r"))) + F.col("tilt") * F.col("r") - F.log(F.lit(2.0)))).alias("scale"))
    product = _product(tilted, size[0], size[1], block, leaf_size)
    tails = product.join(tilts, "g").mapInPandas(_tail_rows(block), "g string, part double").groupBy("g").agg(F.sum("part").alias("tail"))
    found = tails.join(scale, "g").join(tilts, "g")
    p = F.least(F.exp(F.col("scale") - F.col("tilt") * F.col("w2") + F.log("tail")), F.lit(1.0))
    return groups.join(found.select("g", p.alias("p_exact")), "g").select("keys.*", "p_exact")
