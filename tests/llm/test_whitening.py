"""Whitening against the eigenvectors of NumPy and exact whole numbers."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from trialstats.llm import registered, whitening


@pytest.mark.parametrize("rank, d", [(6, 6), (3, 7), (1, 4), (1, 1), (5, 9)])
def test_cholesky_and_jacobi(rank, d):
    rng = np.random.default_rng(rank * 10 + d)
    rows = rng.normal(size=(50, rank)) @ rng.normal(size=(rank, d)) * np.logspace(0, -3, d)
    scatter = rows.T @ rows
    factor = whitening.pivoted_cholesky(scatter)
    assert factor.shape == (d, rank)
    assert np.allclose(factor @ factor.T, scatter, atol=1e-12 * scatter.max())
    turned = whitening.one_sided_jacobi(factor)
    assert np.allclose(turned @ turned.T, scatter, atol=1e-12 * scatter.max())
    gram = turned.T @ turned
    assert np.abs(gram - np.diag(np.diag(gram))).max() <= 1e-13 * scatter.max()
    values = np.linalg.eigvalsh(scatter)[::-1][:rank]
    assert np.allclose(np.diag(gram), values, rtol=1e-9)


def test_equal_eigenvalues_and_nothing():
    turned = whitening.one_sided_jacobi(whitening.pivoted_cholesky(np.eye(4)))
    assert np.allclose(turned @ turned.T, np.eye(4))
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_all_pairs_meet_once():
    for n in range(7):
        met = [(int(a), int(b)) for p, q in whitening._rounds(n) for a, b in zip(p, q, strict=True)]
        assert sorted(met) == [(i, j) for i in range(n) for j in range(i + 1, n)]


def brute(vectors, components=4):
    """Rows as the contract words them, from exact fractions and NumPy's eigenvectors."""
    kept = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * Fraction(float(np.float32(c)))) for c in v)) for i, v in kept]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(c * n - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, x in xs:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        row = np.array([float(Fraction(c * n - s, n)) for c, s in zip(x, sums, strict=True)])
        for k in range(components):
            out.setdefault((i, k + 1), []).append((n, deviation, float(row @ axes[:, k]) / math.sqrt(values[k]), values[k] / np.trace(cov)))
    return out


def compare(got, want):
    found = {}
    for r in got:
        found.setdefault((r[0], r.component), []).append(r)
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    for k in range(1, 5):
        keys = [key for key in want if key[1] == k]
        sign = max((found[key][0].whitened * want[key][0][2] for key in keys), key=abs)
        for key in keys:
            for r, w in zip(sorted(found[key], key=lambda r: r.deviation), sorted(want[key], key=lambda w: w[1]), strict=True):
                assert (r.n, int(r.deviation)) == w[:2]
                assert r.whitened == pytest.approx(math.copysign(1, sign) * w[2], abs=1e-7)
                assert r.explained == pytest.approx(w[3], rel=1e-6)
                assert r.identity_error <= 1e-6


def test_against_numpy(spark, tiny):
    got = registered.QUERIES["op11_whitening"](spark, tiny).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    compare(got, brute(vectors))
    assert {r.identity_error for r in got} == {got[0].identity_error}


SCHEMA = "vec_id bigint, embedding array<float>, x string, _row string, component int, n string"


def made(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", 0, "c") for i, v in rows], SCHEMA)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)]
    odd = [(None, good[0][1]), (7, good[7][1]), (50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0]), (53, [math.nan] * 5), (54, [1.0, math.inf, 0.0, 0.0, 0.0]), (55, [1.0, 2.0])]
    got = whitening.whitened(made(spark, good + odd))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), brute(good + odd[:2]))


def test_hot_vector_and_large_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.5, -2.0, 0.25, 8.0]) for i in range(300)] + [(500 + i, [float(c) for c in rng.normal(size=4) * 1e6]) for i in range(20)]
    compare(whitening.whitened(made(spark, rows).repartition(5)).collect(), brute(rows))


def test_nothing_to_whiten(spark):
    one = made(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whitened(one).collect() == [] == whitening.whitened(one.limit(0)).collect()
    two = whitening.whitened(made(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n) for r in sorted(two, key=lambda r: r.vec_id)] == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert {round(abs(r.whitened), 9) for r in two} == {1.0}
