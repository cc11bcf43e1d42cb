"""Style clusters: scaling, PCA, Gaussian mixtures chosen by BIC, relabelling, and user profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as vx
from quillon.operators.storage import writer
from quillon.operators.sums import matrix, vector_sum

#: Added to variances; rows that a pass takes at once; steps of k-means before the first pass.
FLOOR, ROWS, START_STEPS = 1e-6, 1024, 10


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with vector column features: columns standardised by mean and population deviation (0 for constant ones)."""
    row = df.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    told = df.select("*", *((F.coalesce(F.try_divide(F.col(c) - row[f"m_{i}"], F.lit(row[f"s_{i}"])), F.lit(0.0))).alias(f"_z{i}") for i, c in enumerate(columns)))
    names = [f"_z{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(told).drop(*names)


def reduced(df: DataFrame, low: int = 5, high: int = 10, share: float = 0.9) -> DataFrame:
    """df with array column embedding and vector column pca: the fewest components from low to high that explain share of the variance.

    Moments are summed by task, and only their matrix, as wide as the features, is decomposed on the driver.  The greatest part of each
    component is positive.
    """
    rows = df.select(vector_to_array("features").alias("x"))
    width = len(rows.first().x)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column("x"))
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    sums = vector_sum(rows, moments, 1 + width + width**2)
    mean = sums[1 : 1 + width] / sums[0]
    values, axes = np.linalg.eigh(sums[1 + width :].reshape(width, width) / sums[0] - np.outer(mean, mean))
    values, axes = values[::-1].clip(min=0), axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(width)])
    explained = np.cumsum(values) / max(values.sum(), 1e-300)
    held = min(max(low, int((explained < share).sum()) + 1), high, width)
    turn = axes[:, :held].copy()

    def project(xs: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(xs) @ turn) if len(xs) else [])

    out = df.withColumn("embedding", F.pandas_udf(project, "array<double>")(vector_to_array("features")))
    return out.withColumn("pca", array_to_vector("embedding"))


class Mixtures:
    """Full-covariance mixtures of several sizes and starts, stacked: weights, means and covariances of all their components, and the
    model that each component belongs to."""

    def __init__(self, ks: Sequence[int], width: int):
        self.ks, self.width = np.array(ks), width
        self.model = np.repeat(np.arange(len(ks)), ks)
        self.first = np.cumsum(self.ks) - self.ks
        self.weight = np.repeat(1 / self.ks, ks)
        self.mean = np.zeros((len(self.model), width))
        self.cov = np.zeros((len(self.model), width, width))

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows by components, rows by models): each row's shares within each model, and its log likelihood."""
        factor = np.linalg.inv(np.linalg.cholesky(self.cov))
        scale = np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(axis=1)
        moved = np.einsum("cij,ncj->nci", factor, x[:, None, :] - self.mean[None])
        log = np.log(np.maximum(self.weight, 1e-300)) + scale - 0.5 * (self.width * math.log(2 * math.pi) + (moved**2).sum(axis=2))
        top = np.maximum.reduceat(log, self.first, axis=1)
        share = np.exp(log - top[:, self.model])
        total = np.add.reduceat(share, self.first, axis=1)
        return share / total[:, self.model], top + np.log(total)

    def only(self, models: np.ndarray) -> Mixtures:
        out = Mixtures(self.ks[models], self.width)
        at = np.flatnonzero(np.isin(self.model, models))
        out.weight, out.mean, out.cov = self.weight[at], self.mean[at], self.cov[at]
        return out


def _moments(rows: DataFrame, models: Mixtures) -> tuple[np.ndarray, np.ndarray]:
    """One pass over rows (x): by component the sums of shares, of shares * x and of shares * x x', and by model the log likelihood."""
    n, width = len(models.model), models.width
    size = n * (1 + width + width**2) + len(models.ks)

    def local(batch: pa.RecordBatch) -> np.ndarray:
        x, total = matrix(batch.column(0)), np.zeros(size)
        for low in range(0, len(x), ROWS):
            part = x[low : low + ROWS]
            share, log = models.responsibilities(part)
            outer = (part[:, :, None] * part[:, None, :]).reshape(len(part), -1)
            total += np.concatenate([share.sum(axis=0), (share.T @ part).ravel(), (share.T @ outer).ravel(), log.sum(axis=0)])
        return total

    flat = vector_sum(rows, local, size)
    return flat[: size - len(models.ks)], flat[size - len(models.ks) :]


def _definite(cov: np.ndarray) -> np.ndarray:
    """Covariances with no variance in any direction below FLOOR, which rounding or a component of few rows may leave."""
    values, axes = np.linalg.eigh((cov + cov.swapaxes(-1, -2)) / 2)
    return (axes * np.maximum(values + FLOOR, FLOOR)[..., None, :]) @ axes.swapaxes(-1, -2)


def fit_mixtures(rows: DataFrame, ks: Sequence[int], seeds: Sequence[int], max_iter: int = 50, tolerance: float = 1e-3, max_start: int = 5000) -> tuple[Mixtures, np.ndarray]:
    """One mixture for each of ks and seeds, by EM over rows (x array<double>), and their log likelihoods.

    All models that still move share each pass, so the sweep costs max_iter passes, not one run a model.  Components start from START_STEPS
    steps of k-means on at most max_start rows of least hash, from rows picked far from each other; a model rests once its mean log likelihood rises by less than tolerance.
    """
    sample = np.array([r.x for r in rows.orderBy(F.xxhash64("x"), "x").limit(max_start).collect()])
    width = sample.shape[1]
    models = Mixtures(ks, width)
    spread = np.diag(np.maximum(sample.var(axis=0), FLOOR))
    for m, (k, seed) in enumerate(zip(ks, seeds, strict=True)):
        rng = np.random.default_rng(seed)
        chosen = [sample[rng.integers(len(sample))]]
        while len(chosen) < k:
            far = np.min([((sample - c) ** 2).sum(axis=1) for c in chosen], axis=0)
            chosen.append(sample[rng.choice(len(sample), p=far / far.sum())] if far.sum() > 0 else chosen[0])
        at = np.flatnonzero(models.model == m)
        centres = np.array(chosen)
        for _ in range(START_STEPS):
            nearest = ((sample[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([sample[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(k)])
        for j, c in enumerate(at):
            own = sample[nearest == j]
            models.mean[c], models.weight[c] = centres[j], max(len(own), 1) / (len(sample) + k)
            models.cov[c] = np.cov(own.T, bias=True).reshape(width, width) + FLOOR * np.eye(width) if len(own) > width else spread
    n = rows.count()
    likelihood = np.full(len(ks), -np.inf)
    moving = np.arange(len(ks))
    for _ in range(max_iter):
        part = models.only(moving)
        sums, log = _moments(rows, part)
        c, width = len(part.model), part.width
        share = np.maximum(sums[:c], 1e-10)
        mean = sums[c : c + c * width].reshape(c, width) / share[:, None]
        second = sums[c + c * width :].reshape(c, width, width) / share[:, None, None]
        at = np.flatnonzero(np.isin(models.model, moving))
        models.weight[at] = share / n
        models.mean[at] = mean
        models.cov[at] = _definite(second - mean[:, :, None] * mean[:, None, :])
        still = log / n - likelihood[moving] / n >= tolerance
        likelihood[moving] = log
        moving = moving[still]
        if not len(moving):
            break
    _, likelihood = _moments(rows, models)
    return models, likelihood


def mixture(df: DataFrame, ks: range = range(2, 6), seed: int = 42, starts: int = 1) -> DataFrame:
    """df with cluster (0 for the largest) by the full-covariance mixture of column embedding with the smallest BIC, of starts seeds for each k."""
    df = writer(df.sparkSession, "mixture")(df)
    rows = df.select(F.col("embedding").alias("x"))
    sweep = list(product(ks, range(starts)))
    models, likelihood = fit_mixtures(rows, [k for k, _ in sweep], [seed + s for _, s in sweep])
    n, width = rows.count(), models.width
    k = models.ks
    free = k - 1 + k * width + k * width * (width + 1) / 2
    best = models.only(np.array([int(np.argmin(free * math.log(n) - 2 * likelihood))]))

    def place(xs: pd.Series) -> pd.Series:
        return pd.Series(best.responsibilities(np.stack(xs))[0].argmax(axis=1) if len(xs) else [], dtype="int32")

    placed = writer(df.sparkSession, "mixture")(df.withColumn("prediction", F.pandas_udf(place, "int")("embedding")))
    sizes = placed.groupBy("prediction").agg(F.count("*").alias("n"))
    order = {r["prediction"]: at for at, r in enumerate(sizes.orderBy(F.desc("n"), "prediction").collect())}
    relabel = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    return placed.withColumn("cluster", relabel[F.col("prediction")]).drop("prediction")


def gaussian_profiles(rows: DataFrame, user: str, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """(user, mu, var): a diagonal Gaussian for each user, in place of a trained encoder."""
    return rows.groupBy(user).agg(F.array(*(F.avg(c) for c in columns)).alias("mu"), F.array(*(F.greatest(F.var_pop(c), F.lit(floor)) for c in columns)).alias("var"))


def select_by_threshold(candidates: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Of each user's candidates (user_id, candidate, kl) under the user's threshold the one of least kl; accepted tells if one was."""
    joined = candidates.join(thresholds, "user_id").withColumn("ok", F.col("kl") <= F.col("threshold"))
    best = joined.groupBy("user_id").agg(F.min(F.struct((~F.col("ok")).alias("late"), "kl", "candidate")).alias("b"))
    return best.select("user_id", F.col("b.candidate").alias("candidate"), F.col("b.kl").alias("kl"), (~F.col("b.late")).alias("accepted"))


def kl_to_profile(mu, var, profile_mu, profile_var):
    return vx.gaussian_kl(mu, var, profile_mu, profile_var)
