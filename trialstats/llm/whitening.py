"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers, so that counts, sums and distances are exact. The scatter is summed in matrices of one row per
dimension, which tasks add up; what reaches the driver has as many numbers as the dimension squared, however many vectors
there are. There it is factored with the largest pivot first, and the columns of the factor are turned against each other until
all are orthogonal: their squared lengths are the eigenvalues, and the columns made unit vectors are the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.session import stored_table

SCALE = 256
COMPONENTS = 4
# Columns count as orthogonal once the cosine between them is below this.
_ORTHOGONAL = 1e-15
_SWEEPS = 60


def whole_entries(vectors: Column) -> Column:
    """``floor(256 * entry)`` of each entry, computed in double."""
    return F.transform(vectors, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))))


def usable(vectors: Column) -> Column:
    """The vector is there, has entries, and all are finite."""
    odd = F.exists(vectors, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.isNotNull() & (F.size(vectors) > 0) & ~odd


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """``L`` with ``scatter = L @ L.T``: rows as in ``scatter``, one column per pivot, largest pivot first.

    Ends where what is left is nothing but rounding, so its columns are as many as the rank.
    """
    left = np.array(scatter, np.float64)
    d = len(left)
    columns, limit = [], d * np.finfo(np.float64).eps * max(left.diagonal().max(initial=0.0), 0.0)
    for _ in range(d):
        pivot = int(left.diagonal().argmax())
        if left[pivot, pivot] <= limit:
            break
        column = left[:, pivot] / np.sqrt(left[pivot, pivot])
        columns.append(column)
        left -= np.outer(column, column)
        left[pivot, :] = left[:, pivot] = 0.0
    return np.stack(columns, axis=1) if columns else np.zeros((d, 0))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``n`` columns, in rounds of pairs that share none (a tournament)."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(p), max(p)) for p in zip(seats[:half], seats[: half - 1 : -1], strict=True) if max(p) < n]
        yield np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` times a rotation, with orthogonal columns, longest first."""
    turned = np.array(factor, np.float64)
    for _ in range(_SWEEPS):
        worst = 0.0
        for p, q in _rounds(turned.shape[1]):
            x, y = turned[:, p], turned[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(gamma) / np.maximum(np.sqrt(alpha * beta), np.finfo(np.float64).tiny)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > _ORTHOGONAL
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            tangent = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            cos = 1 / np.sqrt(1 + tangent * tangent)
            sin = cos * tangent
            turned[:, p], turned[:, q] = cos * x - sin * y, sin * x + cos * y
        if worst <= _ORTHOGONAL:
            break
    return turned[:, np.argsort(-np.linalg.norm(turned, axis=0), kind="stable")]


@dataclass(frozen=True)
class Whitening:
    """What was fitted: number of vectors, their exact sums, unit components (one per column) and eigenvalues, largest first."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch.column("x")
        yield np.asarray(column.flatten()).reshape(len(column), d)


def _sums_of(d: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for x in _matrices(batches, d):
            n += len(x)
            # Halves of 32 bits are added apart, so no sum of a batch outgrows 64 bits.
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + k for t, h, k in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_pydict({"i": range(-1, d), "s": [str(n), *map(str, total)]}, schema=pa.schema([("i", pa.int32()), ("s", pa.string())]))

    return sums


def _products_of(d: int, rows_of: Callable[[np.ndarray], np.ndarray]):
    """Sums of products of the columns of ``rows_of`` each matrix, a row per column."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches, d):
            rows = rows_of(x)
            total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": range(len(total)), "row": list(total)}, schema=pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

    return products


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch["i"], batch["row"], strict=True):
            held[i] = held[i] + row if i in held else np.array(row)
    yield pd.DataFrame({"i": pd.Series(held.keys(), dtype="int32"), "row": pd.Series(list(held.values()), dtype=object)})


_ROWS = "i int, row array<double>"


def _product_matrix(fit: DataFrame, d: int, rows_of: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """The ``k`` x ``k`` sums of products over ``fit``; tasks add up a row of it each."""
    partial = fit.mapInArrow(_products_of(d, rows_of), _ROWS)
    rows = {r.i: r.row for r in partial.repartition("i").mapInPandas(_added, _ROWS).collect()}
    return np.array([rows[i] for i in range(k)])


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Each distinct ``x`` once, of the length that most of them have (of two such lengths the larger), and that length.

    Repeats are dropped before the shuffle as well, so a vector that a third of all rows hold is one row of each task.
    """
    distinct = stored_table(vectors.select("x").distinct())
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return distinct, 0
    return distinct.filter(F.size("x") == lengths[0].d), lengths[0].d


def fitted(fit: DataFrame, d: int) -> Whitening | None:
    """Components and eigenvalues of the covariance of ``fit``, with divisor n; nothing where no vector is there."""
    if not d:
        return None
    partial = fit.mapInArrow(_sums_of(d), "i int, s string")
    sums = {r.i: int(r.s) for r in partial.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n, totals = sums[-1], tuple(sums[i] for i in range(d))
    mean = np.array([s / n for s in totals])
    scatter = _product_matrix(fit, d, lambda x: x - mean, d)
    turned = one_sided_jacobi(pivoted_cholesky((scatter + scatter.T) / 2 / n))
    lengths = np.linalg.norm(turned, axis=0)
    return Whitening(n, totals, turned / lengths, lengths**2, float(np.trace(scatter) / n))


def identity_error(fit: DataFrame, d: int, model: Whitening, components: int = COMPONENTS) -> float:
    """Largest entry, without its sign, of the covariance of the whitened fit list less the identity."""
    k = min(components, len(model.eigenvalues))
    mean, scaled = model.mean, model.components[:, :k] / np.sqrt(model.eigenvalues[:k])
    # The whitened values have the mean zero, because x is centred first.
    products = _product_matrix(fit, d, lambda x: (x - mean) @ scaled, k)
    return float(np.abs(products / model.n - np.eye(k)).max())


def _exact_deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[str]:
    """Sum of ``(n * x - sum) ** 2`` over the dimensions: in 64 bits where they hold it, else in Python's numbers."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0))) * n + max(map(abs, sums))
    kind = np.int64 if largest * largest * len(sums) < 2**63 else object
    gaps = x.astype(kind) * n - np.array(sums, kind)
    return [str(v) for v in (gaps * gaps).sum(1).tolist()]


def _whitened_rows(model: Whitening, d: int, components: int):
    mean, scaled = model.mean, model.components[:, :components] / np.sqrt(model.eigenvalues[:components])

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x,) = _matrices([batch], d)
            values = (x - mean) @ scaled
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * values.shape[1], values.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(_exact_deviations(x, model.n, model.sums), pa.string()), lists], ["_row", "deviation", "whitened"])

    return whiten


def whitened(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``<id>, component, n, deviation, whitened, explained, identity_error``: one row for each vector and component.

    Rows whose vector is null, empty, or holds a null or an entry that is not finite are left out, as are vectors of another length than
    most distinct ones have. The fit list is each distinct vector of whole entries once, so repeated rows count once in the
    fit and get a row each. ``deviation`` is exact (DECIMAL). Components are numbered by falling eigenvalue; equal eigenvalues
    leave the choice of their components open, but it is one choice for all rows. There are at most as many components as the rank, so a single
    distinct vector, and an empty table, give no rows. Ids may be null or repeated; other columns are not read.
    """
    v = F.col(f"`{vector_col}`")
    schema = vectors.select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("_row")).schema["_row"].dataType.simpleString()
    rows = vectors.filter(usable(v)).select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("_row"), whole_entries(v).alias("x"))
    fit, d = fit_list(rows)
    model = fitted(fit, d)
    k = 0 if model is None else min(components, len(model.eigenvalues))
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not k:
        kinds = zip(names, ("int", "bigint", "decimal(38,0)", "double", "double", "double"), strict=True)
        return rows.limit(0).select(F.col("_row.id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in kinds])
    error = identity_error(fit, d, model, k)
    out = rows.filter(F.size("x") == d).mapInArrow(_whitened_rows(model, d, k), f"_row {schema}, deviation string, whitened array<double>")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues[:k]])
    return out.select(F.col("_row.id").alias(id_col), F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened")).select(
        id_col,
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("_at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
