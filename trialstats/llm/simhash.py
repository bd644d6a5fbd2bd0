"""SimHash near-duplicates: fingerprints, and their self-join by walking a binary trie against itself.

The fingerprints are the leaves of a trie. Two of its nodes are walked together, child against child,
counting the bits in which their paths differ; a pair of nodes is left as soon as that exceeds the budget.
Three tries hold the bits rotated by a third each: a link of at most two bits agrees on one third of
the bits, so in that trie it lies below one node at depth 21. Those nodes deal the walk over tasks. A node
with too many fingerprints is replaced by the pairs of its descendants eight bits further down, until
none is large. A task returns links that span what it found, never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.common import join_same, whole_text, with_keys, without_keys
from trialstats.llm.components import connected
from trialstats.session import stored_table

SHINGLE = 3
SEED = 42
BUDGET = 2
# With a budget of two, one of three parts has no differing bit.
PART = 21
# Fingerprints that one task walks as one node; larger nodes are split further.
NODE = 1 << 16
STEP = 8

_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_BYTE = np.arange(8) * 256


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number; 0 where there is no word."""
    words = (text or "").encode().translate(_TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(starts), 1 << 16):  # bounded memory for very long texts
        cut = slice(at, at + (1 << 16))
        digests = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[cut], ends[cut], strict=True))
        h = np.fromiter(digests, np.uint64)
        counts += np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048)
    bits = (counts.reshape(8, 256) @ _BITS).ravel() * 2 > len(starts)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _split(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the children of nodes meet; ``bits`` counts the set bits before each leaf."""
    return hi - (bits[hi] - bits[lo])


class _Forest:
    """Union-find over the leaves of a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.labels = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Join the given pairs; those that joined two trees."""
        new = self.labels[a] != self.labels[b]
        made = []
        for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                made.append((i, j))
        if made:
            self.labels = np.array([self.root(i) for i in range(len(self.parent))])
        return made


def walk(leaves: np.ndarray, nodes: np.ndarray, depth: int, budget: int = BUDGET, width: int = 1 << 18) -> list[tuple[int, int]]:
    """Pairs of positions in ``leaves`` that span all links found under pairs of nodes.

    ``leaves``: unsigned fingerprints, sorted inside every node. ``nodes``: rows of ``a_from, a_to, b_from,
    b_to, differing bits so far`` at one depth; where both nodes are the same, it is walked against itself.
    """
    forest, made, counted = _Forest(len(leaves)), [], {}
    stack = [(depth, nodes)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > width:
            stack += [(depth, pairs[i : i + width]) for i in range(0, len(pairs), width)]
            continue
        a, aa, b, bb, used = pairs.T
        single = (aa - a == 1) & (bb - b == 1)
        if single.any():
            x, y = a[single], b[single]
            near = np.bitwise_count(leaves[x] ^ leaves[y]) <= budget
            made += forest.add(x[near], y[near])
            pairs = pairs[~single]
        if len(pairs) and depth < 64:
            # Nodes whose leaves are all joined already have nothing to add.
            changes = np.concatenate([[0], np.cumsum(forest.labels[1:] != forest.labels[:-1])])
            a, aa, b, bb, used = pairs.T
            known = (changes[aa - 1] == changes[a]) & (changes[bb - 1] == changes[b]) & (forest.labels[a] == forest.labels[b])
            a, aa, b, bb, used = pairs[~known].T
            if depth not in counted:
                ones = (leaves >> np.uint64(63 - depth)) & np.uint64(1)
                counted[depth] = np.concatenate([[0], np.cumsum(ones.astype(np.int64))])
            am, bm = _split(counted[depth], a, aa), _split(counted[depth], b, bb)
            self_pair = a == b
            children = [(a, am, b, bm, used), (am, aa, bm, bb, used), (a, am, bm, bb, used + 1)]
            cross = ~self_pair
            children.append((am[cross], aa[cross], b[cross], bm[cross], used[cross] + 1))
            table = np.concatenate([np.stack(c, axis=1) for c in children])
            lone = (table[:, 0] == table[:, 2]) & (table[:, 1] - table[:, 0] < 2)
            alive = (table[:, 0] < table[:, 1]) & (table[:, 2] < table[:, 3]) & (table[:, 4] <= budget) & ~lone
            if alive.any():
                stack.append((depth + 1, table[alive]))
    return made


_TASK = ["trie", "a", "b", "depth", "used"]


def _walk_tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = []

    def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        leaves = rows["leaf"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        depths = rows["depth"].to_numpy()
        keys = rows[_TASK].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        ends = np.append(starts[1:], len(rows))
        sides = np.concatenate([[0], np.cumsum(rows["side"].to_numpy())])
        middles = ends - (sides[ends] - sides[starts])
        itself = keys[starts, 1] == keys[starts, 2]
        nodes = np.stack(
            [starts, np.where(itself, ends, middles), np.where(itself, starts, middles), ends, keys[starts, 4]], axis=1
        )
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3])]
        for depth in np.unique(depths):
            made = walk(leaves, nodes[depths[nodes[:, 0]] == depth], int(depth))
            if made:
                i, j = np.array(made).T
                fps = rows["fp"].to_numpy()
                yield pd.DataFrame({"u": fps[i], "v": fps[j]})

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= NODE:
            rows = pd.concat(held, ignore_index=True)
            last = (rows[_TASK] == rows[_TASK].iloc[-1]).all(axis=1).to_numpy()
            cut = len(rows) - int(last[::-1].argmin()) if not last.all() else 0  # whole nodes only
            yield from done(rows.iloc[:cut].reset_index(drop=True))
            held = [rows.iloc[cut:]]
    if held:
        yield from done(pd.concat(held, ignore_index=True))


def _descendants(tasks: DataFrame, budget: int) -> DataFrame:
    """Each node pair replaced by the pairs of descendants ``STEP`` bits below that the budget allows."""
    masks = [m for m in range(1 << STEP) if m.bit_count() <= budget]
    mask = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(m.bit_count()).alias("more")) for m in masks]))
    step = F.least(F.lit(STEP), 64 - F.col("depth"))
    # Leaves are stored with the top bit flipped, so that signed order is trie order.
    raw = F.col("leaf").bitwiseXOR(F.lit(-(1 << 63)))
    child = F.expr("shiftrightunsigned(_raw, cast(64 - depth - _step AS int))").bitwiseAND(F.expr("shiftleft(1L, cast(_step AS int)) - 1"))
    below = lambda node, bits: F.expr(f"shiftleft({node}, cast(_step AS int))").bitwiseOR(bits)
    rows = tasks.select("*", raw.alias("_raw"), step.alias("_step")).select("*", child.alias("_own"), mask.alias("_k"))
    rows = rows.filter("_k.more + used <= %d AND _k.m < shiftleft(1L, cast(_step AS int))" % budget)
    rows = rows.withColumn("_other", F.col("_own").bitwiseXOR(F.col("_k.m").cast("bigint")))
    itself = F.col("a") == F.col("b")
    first = F.when(itself, F.col("_own") <= F.col("_other")).otherwise(F.col("side") == 0)
    rows = rows.withColumn("_first", first)
    own, other = F.col("_own"), F.col("_other")
    return rows.select(
        "trie",
        below("a", F.when(F.col("_first"), own).otherwise(other)).alias("a"),
        below("b", F.when(F.col("_first"), other).otherwise(own)).alias("b"),
        (F.col("depth") + F.col("_step")).cast("int").alias("depth"),
        (F.col("used") + F.col("_k.more")).cast("int").alias("used"),
        F.when(F.col("_first"), 0).otherwise(1).alias("side"),
        "leaf",
        "fp",
    )


def near_links(fingerprints: DataFrame, node: int = NODE) -> DataFrame:
    """``u, v``: links of at most two bits between the distinct ``fp``, enough to join all that are linked."""
    distinct = stored_table(fingerprints.select("fp").distinct())
    trie = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(t * PART).alias("by")) for t in range(3)]))
    turned = F.expr("shiftleft(fp, _t.by) | shiftrightunsigned(fp, 64 - _t.by)")
    tasks = distinct.select("fp", trie.alias("_t")).select(
        F.col("_t.t").alias("trie"), F.when(F.col("_t.by") == 0, F.col("fp")).otherwise(turned).alias("_raw"), "fp"
    )
    prefix = F.shiftrightunsigned("_raw", 64 - PART)
    tasks = tasks.select(
        "trie", prefix.alias("a"), prefix.alias("b"), F.lit(PART).alias("depth"), F.lit(0).alias("used"), F.lit(0).alias("side"),
        F.col("_raw").bitwiseXOR(F.lit(-(1 << 63))).alias("leaf"), "fp",
    )
    ready = None
    while True:
        sizes = tasks.groupBy(*_TASK).agg(F.count("*").alias("n"))
        large = stored_table(sizes.filter(F.col("n") > node).drop("n"))
        if large.isEmpty():
            ready = tasks if ready is None else ready.unionByName(tasks)
            break
        small = tasks.join(large, _TASK, "left_anti").select(*tasks.columns)
        ready = small if ready is None else ready.unionByName(small)
        tasks = stored_table(_descendants(tasks.join(large, _TASK, "left_semi").select(*tasks.columns), BUDGET))
    dealt = ready.repartition(*_TASK).sortWithinPartitions(*_TASK, "side", "leaf")
    return dealt.mapInPandas(_walk_tasks, "u bigint, v bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node: int = NODE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, text_hash, component_id``.

    ``component_id`` is the smallest id that is reached over links of at most two differing bits. A null or
    empty text has fingerprint 0. A null id is never a component's id, unless all its ids are null.
    Repeated rows are returned as often as they come; an empty table gives no rows.
    """
    text = whole_text(text_col)
    rows = stored_table(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(text).alias("fp"), F.xxhash64(text).alias("text_hash")))
    roots = connected(near_links(rows, node))
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    placed = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = stored_table(placed)
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = stored_table(placed.join(least, "root").select("fp", "component_id"))
    return rows.join(groups, "fp").select("doc_id", "fp", "text_hash", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all their columns.

    Rows that share their id and text are one document; rows without an id stay.
    """
    groups = simhash_groups(docs, id_col, text_col)
    lost = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = with_keys(docs, _id=F.col(id_col), _hash=F.xxhash64(whole_text(text_col)))
    return without_keys(join_same(rows, lost, ["_id", "_hash"], "left_anti"))
