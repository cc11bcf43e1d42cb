from __future__ import annotations

import math

import numpy as np
from compare import SMALL

from quillon.operators import clusters
from quillon.plans import catalog


def points(spark, n=300):
    rng = np.random.default_rng(4)
    rows = [(k, (np.array([[0, 0], [6, 1], [-5, 7]])[k % 3] + rng.normal(size=2) * [1.0, 0.5]).tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<double>")


def test_mixtures_rest_and_agree_with_one_fit_at_a_time(spark):
    rows, df = points(spark)
    xs = df.selectExpr("embedding AS x")
    models, likelihood = clusters.fit_mixtures(xs, [2, 3, 3], [1, 1, 2])
    alone, own = clusters.fit_mixtures(xs.repartition(3), [3], [1])
    part = models.only(np.array([1]))
    assert np.allclose(sorted(part.mean.tolist()), sorted(alone.mean.tolist()), atol=1e-6) and abs(own[0] - likelihood[1]) < 1e-4
    x = np.array([r[1] for r in rows])
    plain = sum(math.log(sum(w * math.exp(-0.5 * (p - m) @ np.linalg.inv(c) @ (p - m)) / (2 * math.pi * math.sqrt(np.linalg.det(c))) for w, m, c in zip(part.weight, part.mean, part.cov, strict=True))) for p in x)
    assert abs(plain - likelihood[1]) < 1e-6
    # A further step of EM in NumPy hardly moves it: the fit is where MLlib's EM would rest, too.
    density = np.stack([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(c)) for w, m, c in zip(part.weight, part.mean, part.cov, strict=True)], axis=1)
    shares = density / density.sum(axis=1, keepdims=True)
    assert np.allclose(shares.mean(axis=0), part.weight, atol=0.02) and np.allclose((shares.T @ x) / shares.sum(axis=0)[:, None], part.mean, atol=0.1)


def test_bic_picks_the_number_of_groups(spark):
    _, df = points(spark)
    found = clusters.mixture(df, range(2, 6), starts=3).collect()
    assert {(r.id % 3, r.cluster) for r in found} == {(r.id % 3, r.cluster) for r in found[:3]} or len({r.cluster for r in found}) == 3
    assert len({(r.id % 3, r.cluster) for r in found}) == 3


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([tuple(r) for r in x.tolist()], ", ".join(f"c{k} double" for k in range(6)))
    found = clusters.reduced(clusters.scaled(df, df.columns), low=2, high=4, share=0.5).collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, axes = np.linalg.eigh(z.T @ z / 200)
    order = np.argsort(-values)
    held = min(max(2, int((np.cumsum(values[order]) / values.sum() < 0.5).sum()) + 1), 4)
    want = np.abs(z @ axes[:, order[:held]])
    at = {tuple(np.round(r, 9)): w for r, w in zip(x, want, strict=True)}
    assert all(np.allclose(np.abs(r.embedding), at[tuple(np.round([r[f"c{k}"] for k in range(6)], 9))]) for r in found)


def test_registered_sweep_ends(spark):
    found = catalog.pca_gmm_clusters(spark, SMALL).collect()
    assert len(found) == 500 and 2 <= len({r.cluster for r in found}) <= 8
