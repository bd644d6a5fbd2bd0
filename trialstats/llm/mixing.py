"""Mixing to target weights: iterative proportional fitting over cells, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import join_same, whole_text, with_keys
from trialstats.session import stored_table

SWEEPS = 60
TOLERANCE = 1e-6
FRACTION = 0.5
TOPICS = 8
DIMENSIONS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def opening_topic(text: Column, topics: int = TOPICS) -> Column:
    """A stand-in for a topic, for tables that have none: the first word, hashed to one of ``topics``."""
    return F.pmod(F.xxhash64(F.lower(F.regexp_extract(text, r"[^\x20\x09-\x0D]+", 0))), F.lit(topics)).cast("string")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares ``<dimension>, share`` in proportion to a power of the tokens: 1 keeps shares, 0 makes them equal."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).filter("t > 0")
    return sums.select(dimension, F.pow("t", F.lit(power)).alias("share"))


def _numbers(values: np.ndarray) -> Column:
    """A constant array of doubles."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")


def _row_factor(factors: Column) -> Column:
    """The factor that gives a row of cells its wanted mass, where the places of the cells have these factors."""
    masses = F.zip_with("_at", "_tokens", lambda at, tokens: tokens * F.get(factors, at))
    have = F.aggregate(masses, F.lit(0.0), lambda x, y: x + y)
    return F.when(have > 0, F.col("wanted") / have).otherwise(0.0)


def _swept(rows: DataFrame, trail: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """The masses by place of the next sweep, once the first dimension is scaled, and what the sweep before moved.

    ``trail`` ends with the factors of the places after the last three sweeps, or fewer.
    """
    ends = [_numbers(x) for x in trail]
    now = rows.select("*", *[_row_factor(x).alias(f"_by{i}") for i, x in enumerate(ends)])

    def mass(i: int, at: Column, tokens: Column) -> Column:
        return tokens * F.col(f"_by{i - 1}") * F.get(ends[i], at) if i else tokens

    last = len(ends) - 1
    scaled = F.zip_with("_at", "_tokens", lambda at, tokens: F.struct(at.alias("at"), (tokens * F.col(f"_by{last}") * F.get(ends[last], at)).alias("mass")))
    if last:
        steps = F.zip_with("_at", "_tokens", lambda at, tokens: F.abs(mass(last, at, tokens) - mass(last - 1, at, tokens)))
        moved = F.aggregate(steps, F.lit(0.0), lambda x, y: x + y)
        scaled = F.concat(scaled, F.array(F.struct(F.lit(-1).alias("at"), moved.alias("mass"))))
    sums = dict(now.select(F.inline(scaled)).groupBy("at").agg(F.sum("mass")).collect())
    return np.array([sums.get(i, 0.0) for i in range(len(trail[-1]))]), sums.get(-1, 0.0)


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``mass``: their ``tokens`` scaled until each dimension has its target shares of all tokens.

    Shares are taken in proportion over the values that have tokens; a value without a share gets no mass. Where targets
    contradict each other the last dimension holds. A mass is the tokens times one factor per dimension. The cells of a value of the first
    dimension, which may have many, are one stored row; what the steps of the others need of them is their sum by the values of
    the other dimensions. So a sweep is one aggregate, whose shuffle carries a row per task and combination of the other dimensions, and the
    driver holds a number per combination. Sweeps end when one moves less than ``tolerance`` of all mass.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = {}
    for name, shares in targets.items():
        live = cells.filter("tokens > 0").select(name).distinct()
        live = join_same(shares.filter("share > 0").groupBy(name).agg(F.sum("share").alias("share")), live, [name], "left_semi")
        wanted[name] = stored_table(live)
    whole = {name: live.agg(F.sum("share")).first()[0] or 1.0 for name, live in wanted.items()}
    if not targets or sweeps < 1:
        return stored_table(cells.select("*", F.col("tokens").cast("double").alias("mass")))
    first, *others = targets
    if others:
        met = cells.agg(F.array_sort(F.collect_set(F.struct(*others))).alias("_met"))
        place = stored_table(met.select(F.posexplode("_met").alias("_place", "_values")).select("_place", "_values.*"))
        places = [tuple(r)[1:] for r in sorted(place.collect(), key=lambda r: r[0])]
        placed = join_same(cells, place, others, "inner")
    else:
        places, placed = [()], cells.withColumn("_place", F.lit(0))
    if not places:
        return stored_table(cells.select("*", F.col("tokens").cast("double").alias("mass")))
    cell = F.struct("_place", F.col("tokens").cast("double").alias("_tokens"))
    held = placed.filter("tokens IS NOT NULL").groupBy(first).agg(F.collect_list(cell).alias("_cells"))
    mass = F.coalesce(F.col("share") / whole[first] * total, F.lit(0.0)).alias("wanted")
    rows = join_same(held, wanted[first], [first], "left").select(first, F.col("_cells._place").alias("_at"), F.col("_cells._tokens").alias("_tokens"), mass)
    rows = stored_table(rows)

    steps = []  # of each other dimension: which of its values a place has, and the mass that each value should have
    for k, name in enumerate(others):
        values = {v: i for i, v in enumerate({p[k] for p in places})}
        goal = np.zeros(len(values))
        for r in wanted[name].collect():
            goal[values[r[name]]] = r.share / whole[name] * total
        steps.append((np.array([values[p[k]] for p in places], np.int64), goal))
    trail = [np.ones(len(places))]
    for sweep in range(sweeps):
        now, moved = _swept(rows, trail)
        if sweep and moved <= tolerance * total:
            break
        factors = trail[-1]
        for value, goal in steps:
            sums = np.bincount(value, now, minlength=len(goal))
            scale = np.where(sums > 0, goal / np.where(sums > 0, sums, 1), 0.0)[value]
            factors, now = factors * scale, now * scale
        trail = [*trail, factors][-3:]
    fitted = join_same(cells, rows.select(first, _row_factor(_numbers(trail[-2])).alias("_first")), [first], "left")
    if others:
        fitted = join_same(fitted, place.select(*others, F.get(_numbers(trail[-1]), "_place").alias("_other")), others, "left")
    else:
        fitted = fitted.withColumn("_other", F.lit(1.0))
    fitted = fitted.withColumn("mass", F.col("tokens") * F.col("_first") * F.col("_other"))
    return stored_table(fitted.drop("_first", "_other"))


def calibration(cells: DataFrame, budget: float) -> float:
    """The factor ``c`` for which probabilities ``min(1, c * mass / tokens)`` give ``budget`` expected tokens.

    Cells whose probability reaches one are taken out of the budget, and the rest shares what is left; one small
    aggregate per round, and cells only ever enter.
    """
    c, before = 0.0, -1
    while True:
        full = F.col("mass") * c >= F.col("tokens")
        live = cells.filter("mass > 0 AND tokens > 0")
        row = live.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("tokens"))).alias("t"), F.sum(F.when(~full, F.col("mass"))).alias("m")
        ).first()
        if row.n == before or not row.m:
            return c if row.m or before >= 0 else 0.0
        before, c = row.n, max(c, (budget - (row.t or 0)) / row.m)


def mixture(
    docs: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    fraction: float = FRACTION,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, source, lang, topic, n_tokens, probability, weight, sampled``.

    ``targets`` gives ``<dimension>, share`` for source, lang and topic; by default shares are tempered towards
    equal ones. ``fraction`` of all tokens is expected in the sample. ``weight`` is above 1 where a cell is too
    small for its target: what its documents must count for to meet the marginals. The draw is a hash of id and
    seed, so it does not depend on partitioning; rows that repeat an id are drawn together. A null source or
    language is a value of its own; texts without words have no tokens and probability 0. An empty table gives no rows.
    """
    text = whole_text(text_col)
    topic = opening_topic(text) if topic is None else topic
    rows = stored_table(
        docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), "source", "lang",
            topic.alias("topic"), token_count(text).alias("n_tokens"),
        )
    )
    cells = stored_table(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    if targets is None:
        targets = {"source": tempered(cells, "source", 0.7), "lang": tempered(cells, "lang", 0.5), "topic": tempered(cells, "topic", 0.0)}
    fitted = rake(cells, targets)
    budget = fraction * (cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = F.lit(calibration(fitted, budget)) * F.col("mass") / F.col("tokens")
    wanted = F.when(F.col("tokens") > 0, wanted).otherwise(0.0)
    rates = stored_table(fitted.select(*DIMENSIONS, F.least(wanted, F.lit(1.0)).alias("probability"), F.greatest(wanted, F.lit(1.0)).alias("weight")))
    out = join_same(rows, rates, DIMENSIONS, "inner")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    empty = F.col("n_tokens") == 0
    out = out.withColumn("probability", F.when(empty, 0.0).otherwise(F.col("probability")))
    return out.withColumn("sampled", draw < F.col("probability"))


def sampled_documents(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns, and ``mix_weight``."""
    chosen = mixture(docs, **options).filter("sampled")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("weight").alias("mix_weight")).distinct()
    rows = with_keys(docs, _id=F.col(id_col), _hash=F.xxhash64(whole_text(text_col)))
    return join_same(rows, chosen, ["_id", "_hash"], "inner").select("_row.*", "mix_weight")
