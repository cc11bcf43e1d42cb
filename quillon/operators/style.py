"""Style vectors: a probe that tells how well they predict text features, and an axis fitted on one table and applied to another.

Statistics are sums of bounded size, added up by task; matrices of a few hundred
columns are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.sums import matrix, vector_sum

FOLDS = 10


def fold(key: Column, folds: int = FOLDS) -> Column:
    """A row's fold by the CRC-32 of its key as text; null counts as empty."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


@dataclass(frozen=True)
class Kernel:
    """Random features whose products approximate a Gaussian kernel exp(-gamma |x - y|^2), and a constant."""

    waves: np.ndarray
    phases: np.ndarray

    @staticmethod
    def draw(width: int, components: int, gamma: float, seed: int) -> Kernel:
        rng = np.random.default_rng(seed)
        return Kernel(rng.normal(size=(width, components)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, components))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.waves + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])


def probe(rows: DataFrame, components: int = 64, gamma: float | None = None, ridge: float = 1.0, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """(feature, n, mse, variance) for each place of y over rows (id, x array<double>, y array<double>): the squared error of predictions
    by rows of other folds.

    Each fold has its own scaler and ridge regression on random features, both fitted on the other folds: three passes over the rows, however many folds.
    gamma is 1 / width by default.  Rows with a null in x or y, or without them, are left out; a fold without other rows predicts zero.
    """
    spark = rows.sparkSession
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull())
    held = rows.where(whole("x") & whole("y")).select(fold(F.col("id"), folds).alias("fold"), F.col("x").cast("array<double>"), F.col("y").cast("array<double>"))
    one = held.first()
    schema = "feature int, n long, mse double, variance double"
    if one is None:
        return spark.createDataFrame([], schema)
    width, outs = len(one.x), len(one.y)
    kernel = Kernel.draw(width, components, 1 / width if gamma is None else gamma, seed)
    size = components + 1

    def by_fold(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of rows of values by fold."""
        out = np.zeros((folds, values.shape[1]))
        np.add.at(out, at, values)
        return out.ravel()

    def first(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column("x"))
        return by_fold(np.hstack([np.ones((len(x), 1)), x, x**2]), batch.column("fold").to_numpy())

    sums = vector_sum(held, first, folds * (1 + 2 * width)).reshape(folds, -1)
    others = sums.sum(axis=0) - sums
    n = np.maximum(others[:, :1], 1)
    mean = others[:, 1 : 1 + width] / n
    spread = np.sqrt(np.maximum(others[:, 1 + width :] / n - mean**2, 0))
    spread[spread == 0] = 1.0

    def second(batch: pa.RecordBatch) -> np.ndarray:
        x, y, at = matrix(batch.column("x")), matrix(batch.column("y")), batch.column("fold").to_numpy()
        out = np.zeros((folds, size, size + outs))
        for f in range(folds):
            on = at != f
            z = kernel.features((x[on] - mean[f]) / spread[f])
            out[f] = z.T @ np.hstack([z, y[on]])
        return out.ravel()

    normal = vector_sum(held, second, folds * size * (size + outs)).reshape(folds, size, size + outs)
    penalty = ridge * np.diag([1.0] * components + [1e-9])
    weights = np.array([np.linalg.solve(m[:, :size] + penalty, m[:, size:]) for m in normal])

    def third(batch: pa.RecordBatch) -> np.ndarray:
        x, y, at = matrix(batch.column("x")), matrix(batch.column("y")), batch.column("fold").to_numpy()
        out = np.zeros((4, outs))
        for f in np.unique(at):
            on = at == f
            miss = y[on] - kernel.features((x[on] - mean[f]) / spread[f]) @ weights[f]
            out += np.stack([np.full(outs, on.sum()), (miss**2).sum(axis=0), y[on].sum(axis=0), (y[on] ** 2).sum(axis=0)])
        return out.ravel()

    count, miss, total, squares = vector_sum(held, third, 4 * outs).reshape(4, outs)
    found = [(k, int(count[k]), float(miss[k] / count[k]), float(squares[k] / count[k] - (total[k] / count[k]) ** 2)) for k in range(outs)]
    return spark.createDataFrame(found, schema)


@dataclass(frozen=True)
class Axis:
    """A scaler and a direction."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]
    direction: tuple[float, ...]

    def score(self, columns: Sequence[str]) -> Column:
        """A row's place on the axis; null where a column is."""
        parts = [(F.col(c).cast("double") - m) / s * d for c, m, s, d in zip(columns, self.mean, self.spread, self.direction, strict=True)]
        return sum(parts[1:], parts[0])


def fit_axis(rows: DataFrame, columns: Sequence[str], along: str) -> Axis:
    """The first principal component of the standardised columns, turned so that scores of rows rise with column along.

    Rows with a null among the columns are left out of the fit; a constant column counts as 0.  A correlation of 0 or none leaves the
    direction whose greatest part is positive.  Fit on one table and use score() on another.
    """
    width = len(columns)
    held = rows.where(~F.greatest(*(F.col(c).isNull() for c in columns))).select(F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.col(along).cast("double").alias("a"))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column("x"))
        a = batch.column("a").to_numpy(zero_copy_only=False).astype(np.float64)
        known = ~np.isnan(a)
        k, a = x[known], a[known]
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel(), [known.sum(), a.sum()], k.sum(axis=0), k.T @ a])

    sums = vector_sum(held, moments, 3 + width + width**2 + 2 * width)
    n, total, second = sums[0], sums[1 : 1 + width], sums[1 + width : 1 + width + width**2].reshape(width, width)
    if not n:
        raise ValueError("no rows to fit an axis on")
    mean = total / n
    cov = second / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    flat = spread < 1e-12
    spread[flat] = 1.0
    corr = np.where(flat[:, None] | flat[None], 0.0, cov / np.outer(spread, spread))
    direction = np.linalg.eigh(corr)[1][:, -1]
    direction = direction * np.sign(direction[np.abs(direction).argmax()])
    known, total_a, total_x, cross = sums[-2 - 2 * width], sums[-1 - 2 * width], sums[-2 * width : -width], sums[-width:]
    if known:
        rise = ((cross - total_x * total_a / known) / spread * np.where(flat, 0, direction)).sum()
        direction = -direction if rise < 0 else direction
    return Axis(tuple(mean.tolist()), tuple(spread.tolist()), tuple(direction.tolist()))
