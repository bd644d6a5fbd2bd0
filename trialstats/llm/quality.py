"""Quality and toxicity by a small classifier, combined with site rates by hierarchical empirical Bayes.

A classifier gives every document a probability of being poor. Their sums per path and host are the evidence
about sites: a host's rate is shrunk towards the rate of all documents, a path's rate towards its host's, each
by a prior strength that is estimated from how much sites differ. A document is judged by its own
evidence with the rate of its path, less its own share in it, in place of the overall rate.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import join_same, whole_text, with_keys, without_keys
from trialstats.session import stored_table

# Labelled rows, by hash of their id, that the classifier is fitted on.
LABELLED = 20_000
# Features kept for each of the two targets, by chi-square, and the least chi-square of a kept one.
FEATURES = 2_000
LEAST_CHI = 25.0
REJECT = 0.5
# Steps and ridge penalty (in documents) of the fit.
STEPS = 400
RIDGE = 0.3
# Bounds of a prior's strength, in documents.
STRENGTH = (1.0, 1e6)

_EDGES = "\"'()[]{}<>.,;:!?%*$#&|~^_=+-/\\`"
TARGETS = ("low", "toxic")


def features(text: str | None) -> set[str]:
    """The distinct words of a text, how they begin and which symbols they end with, and what shape it has."""
    words = (text or "").lower().split()
    n = len(words)
    out = {f"!words {n.bit_length()}"}
    if not n:
        return out
    seen = set(words)
    for word in seen:
        core = word.strip(_EDGES)
        if core:
            out.add(core)
            out.add("^" + core[:5])
        tail = len(word) - len(word.rstrip(_EDGES))
        if tail > 1 or not core:
            out.add("~" + word[-3:])
    repeats = sum(map(str.__eq__, words, words[1:]))
    symbols = sum(map(text.count, "%*$#&|"))
    out.add(f"!variety {n.bit_length()} {10 * len(seen) // n}")
    out.add(f"!repeats {10 * repeats // n}")
    out.add(f"!symbols {min(9, 4 * symbols // n)}")
    return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        totals = {name: Counter() for name in ("n", *TARGETS)}
        for text, low, toxic in zip(batch["text"], batch["low"], batch["toxic"], strict=True):
            found = features(text) | {""}  # the empty feature counts the documents
            totals["n"].update(found)
            for name, is_so in zip(TARGETS, (low, toxic), strict=True):
                if is_so:
                    totals[name].update(found)
        frame = pd.DataFrame({"feature": list(totals["n"])})
        for name, counts in totals.items():
            frame[name] = frame["feature"].map(counts).fillna(0).astype("int64")
        yield frame


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """``text, low, toxic`` of at most ``rows`` labelled documents, those whose ids hash lowest."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    chosen = known.select(
        "doc_id", (F.col("quality") == 0).alias("low"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic")
    )
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "low", "toxic").limit(rows)
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").drop("doc_id")


class Classifier:
    """Log odds of both targets, from the features that are present. Holds a bounded number of weights."""

    def __init__(self, weights: dict[str, tuple[float, float]], base: tuple[float, float]):
        self.weights, self.base = weights, base

    def log_odds(self, text: str | None) -> tuple[float, float]:
        low, toxic = self.base
        for name in features(text) & self.weights.keys():
            a, b = self.weights[name]
            low, toxic = low + a, toxic + b
        return low, toxic


def _telling(counts: DataFrame, name: str, total) -> list[str]:
    """Features that go with a target, best first, by chi-square."""
    all_of, rest = total[name], total.n - total[name]
    if not all_of or not rest:
        return []
    with_it, n = F.col(name), F.col("n")
    expected = n * all_of / total.n
    chi = (with_it - expected) ** 2 / (expected * (1 - n / (total.n + 1.0)) * rest / total.n)
    told = counts.filter("feature <> '' AND n >= 3").filter(with_it > expected).select("feature", chi.alias("chi"))
    return [r.feature for r in told.filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()]


def _logistic(names: list[str]):
    """Fits both targets on all rows of one task: they are the bounded sample, as numbers of a bounded set of features."""
    index = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, labels = [], []
        for batch in batches:
            found += [np.array(sorted(index[f] for f in features(t) & index.keys()), np.int64) for t in batch["text"]]
            labels.append(batch[list(TARGETS)].to_numpy(float))
        if not found:
            return
        y = np.concatenate(labels)
        cols = np.concatenate(found)
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        weights = np.zeros((len(names) + 1, len(TARGETS)))
        for k in range(len(TARGETS)):
            w, b = np.zeros(len(names)), 0.0
            step, first, second = 0.1, np.zeros(len(names) + 1), np.zeros(len(names) + 1)
            for t in range(1, STEPS + 1):
                z = b + np.bincount(rows, w[cols], len(found))
                off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[:, k]
                slope = np.append(np.bincount(cols, off[rows], len(names)) + RIDGE * w, off.sum()) / len(found)
                first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
                move = step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
                w, b = w - move[:-1], b - move[-1]
            weights[:, k] = np.append(w, b)
        yield pd.DataFrame({"feature": [*names, ""], "low": weights[:, 0], "toxic": weights[:, 1]})

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> Classifier:
    """Logistic regression over the features that go with a target. Without labels nothing is ever rejected."""
    sample = stored_table(labelled_sample(docs, labels, rows))
    counts = sample.mapInPandas(_counts, "feature string, n bigint, low bigint, toxic bigint")
    counts = stored_table(counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]))
    total = counts.filter("feature = ''").first()
    if total is None:
        return Classifier({}, (-20.0, -20.0))
    shapes = [r.feature for r in counts.filter("feature LIKE '!%'").select("feature").orderBy("feature").collect()]
    names = sorted({*shapes, *_telling(counts, "low", total), *_telling(counts, "toxic", total)})
    fitted = sample.repartition(1).mapInPandas(_logistic(names), "feature string, low double, toxic double").collect()
    weights = {r.feature: (r.low, r.toxic) for r in fitted}
    return Classifier(weights, weights.pop(""))


def score(model: Classifier) -> Callable[[Column], Column]:
    """A column function: ``low, toxic`` log odds of a text."""

    @F.pandas_udf("low double, toxic double")
    def odds(texts: pd.Series) -> pd.DataFrame:
        found = np.array([model.log_odds(t) for t in texts], float).reshape(-1, 2)
        return pd.DataFrame({"low": found[:, 0], "toxic": found[:, 1]})

    return odds


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _strength(groups: DataFrame, prior: str) -> float:
    """Prior documents by the method of moments; ``groups`` holds ``n, s`` and the rate of the level above."""
    mean, n = F.col("s") / F.col("n"), F.col("n")
    row = groups.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(n * n).alias("nn"),
        F.sum("s").alias("s"),
        F.sum(n * (mean - F.col(prior)) ** 2).alias("between"),
    ).first()
    if not row.n or row.k < 2:
        return STRENGTH[0]
    m = row.s / row.n
    spread = (row.between - (row.k - 1) * m * (1 - m)) / (row.n - row.nn / row.n) if row.nn < row.n**2 else 0
    return min(STRENGTH[1], max(STRENGTH[0], m * (1 - m) / spread - 1)) if spread > 0 else STRENGTH[1]


def site_rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """``host, path, host_rate, path_rate`` with the sums behind them, and the rate of all documents.

    ``scored`` holds ``host, path, p``. All sums are combined before the shuffle, so a host with a third of all
    documents costs no more than another.
    """
    paths = stored_table(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (whole.s + 0.5) / (whole.n + 1) if whole.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("rate", F.lit(rate))
    hosts = stored_table(hosts)
    k = _strength(hosts, "rate")
    hosts = hosts.select("host", ((F.lit(k * rate) + F.col("s")) / (F.lit(k) + F.col("n"))).alias("host_rate"))
    paths = stored_table(join_same(paths, hosts, ["host"], "inner"))
    k = _strength(paths, "host_rate")
    prior = F.lit(k) * F.col("host_rate")
    return paths.select("host", "path", "host_rate", "n", "s", prior.alias("prior"), F.lit(k).alias("strength")), rate


def judge(
    docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, p_low, p_toxic, host_rate, path_rate, p_reject, kept``.

    A null or empty text is judged by the overall rates and its site. A null host or path is a site of its own.
    Repeated rows count as often as they come. Labels without an id or quality are left out; without any
    labels, every document is kept. An empty table gives no rows.
    """
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path")
    )
    odds = score(fit(docs, labels))
    text = whole_text()
    scored = docs.select("doc_id", "host", "path", F.xxhash64(text).alias("text_hash"), odds(text).alias("_o"))
    low, toxic = _chance(F.col("_o.low")), _chance(F.col("_o.toxic"))
    scored = stored_table(scored.select("doc_id", "host", "path", "text_hash", low.alias("p_low"), toxic.alias("p_toxic")))
    scored = scored.withColumn("p", 1 - (1 - F.col("p_low")) * (1 - F.col("p_toxic")))
    sites, rate = site_rates(scored)
    rows = join_same(scored, stored_table(sites), ["host", "path"], "inner")
    # The document's own evidence is not counted twice.
    others = (F.col("prior") + F.col("s") - F.col("p")) / (F.col("strength") + F.col("n") - 1)
    tiny = 1e-9
    others = F.least(F.greatest(others, F.lit(tiny)), F.lit(1 - tiny))
    p = F.least(F.greatest(F.col("p"), F.lit(tiny)), F.lit(1 - tiny))
    logit = lambda x: F.log(x / (1 - x))
    reject = _chance(logit(p) + logit(others) - F.lit(math.log(rate / (1 - rate))))
    return rows.select(
        "doc_id", "text_hash", "p_low", "p_toxic", "host_rate", others.alias("path_rate"), reject.alias("p_reject")
    ).withColumn("kept", F.col("p_reject") < REJECT)


def drop_poor(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. Rows without an id stay."""
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    lost = judge(docs, labels, **columns).filter("NOT kept AND doc_id IS NOT NULL")
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = with_keys(docs, _id=F.col(id_col), _hash=F.xxhash64(whole_text(text_col)))
    return without_keys(join_same(rows, lost, ["_id", "_hash"], "left_anti"))
