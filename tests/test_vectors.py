"""The compressed late-interaction index, the style probe and the style axis beside NumPy."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from compare import SMALL
from pyspark.sql import functions as F

from quillon.operators import late_index, style
from quillon.plans import catalog


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_codes_pack_and_unpack(bits):
    buckets = np.random.default_rng(bits).integers(0, 1 << bits, 37)
    assert late_index.unpack(late_index.pack(buckets, bits), 37, bits).tolist() == buckets.tolist()
    assert len(late_index.pack(buckets, bits)) == -(-37 * bits // 8)


def clustered(spark, n=400):
    """Documents of one to six tokens around forty directions, one without a token, and queries near documents."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    docs = [(k, unit(centres[rng.integers(0, 40, rng.integers(1, 7))] + 0.25 * rng.normal(size=(1, 16))).tolist()) for k in range(n)]
    queries = [(k, unit(np.array(docs[k * 7][1]) + 0.05 * rng.normal(size=(len(docs[k * 7][1]), 16))).tolist()) for k in range(30)]
    return spark.createDataFrame([*docs, (n, [])], "doc_id long, toks array<array<double>>"), spark.createDataFrame([*queries, (99, [])], "query_id long, toks array<array<double>>")


def test_index_holds_every_token_and_finds_the_best(spark):
    docs, queries = clustered(spark)
    index = late_index.build(docs, cells=64)
    codes = {r.doc_id: r for r in index.codes.collect()}
    given = {r.doc_id: np.array(r.toks) for r in docs.collect() if r.toks}
    assert {d: len(r.cells) for d, r in codes.items()} == {d: len(m) for d, m in given.items()}
    held = {d: late_index.decompressed(index.centroids, index.values, r.cells, r.codes) for d, r in codes.items()}
    raw = np.concatenate([given[d] - index.centroids[codes[d].cells] for d in given])
    assert np.linalg.norm(np.concatenate([held[d] - given[d] for d in given])) < 0.5 * np.linalg.norm(raw)
    assert {(r.doc_id, r.cell) for r in index.lists.collect()} == {(d, c) for d, r in codes.items() for c in r.cells}
    probes = 6
    found = late_index.search(index, docs, queries, k=10, probes=probes, candidates=200, rescored=60).collect()
    hits = 0
    for q in queries.collect():
        if not q.toks:
            continue
        scores = {d: float((np.array(q.toks) @ m.T).max(axis=1).sum()) for d, m in given.items()}
        best = sorted(scores, key=lambda d: (-round(scores[d], 6), d))[:10]
        own = {r.doc_id: r.score for r in found if r.query_id == q.query_id}
        assert all(abs(scores[d] - s) < 1e-5 for d, s in own.items())
        hits += len(set(best) & set(own))
    assert hits >= 0.9 * 300 and probes < 64 / 4 and 99 not in {r.query_id for r in found}


def test_registered_index_recalls_the_exact_search(spark):
    exact = {(r.query_id, r.doc_id) for r in catalog.maxsim_topk(spark, SMALL).collect()}
    near = {(r.query_id, r.doc_id) for r in catalog.compressed_maxsim_topk(spark, SMALL).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_probe_equals_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) * [1, 2, 3, 1, 0]
    y = np.stack([np.sin(x[:, 0]) + 0.1 * rng.normal(size=300), rng.normal(size=300)], axis=1)
    rows = [(f"r{k}", x[k].tolist(), y[k].tolist()) for k in range(300)]
    df = spark.createDataFrame([*rows, ("null", None, [1.0, 1.0]), ("part", [1.0, None, 1.0, 1.0, 1.0], [1.0, 1.0])], "id string, x array<double>, y array<double>")
    found = sorted(tuple(r) for r in style.probe(df.repartition(3), components=40).collect())
    at = np.array([zlib.crc32(r[0].encode()) % 10 for r in rows])
    kernel = style.Kernel.draw(5, 40, 0.2, 42)
    miss = np.zeros_like(y)
    for f in range(10):
        own, rest = at == f, at != f
        mean, spread = x[rest].mean(axis=0), x[rest].std(axis=0)
        spread[spread == 0] = 1
        z = kernel.features((x[rest] - mean) / spread)
        w = np.linalg.solve(z.T @ z + np.diag([1.0] * 40 + [1e-9]), z.T @ y[rest])
        miss[own] = y[own] - kernel.features((x[own] - mean) / spread) @ w
    want = (miss**2).mean(axis=0)
    assert np.allclose([r[2] for r in found], want) and np.allclose([r[3] for r in found], y.var(axis=0)) and [r[1] for r in found] == [300, 300]
    assert found[0][2] < 0.5 * found[0][3] and found[1][2] > 0.8 * found[1][3]
    assert style.probe(df.where("false")).count() == 0


def test_axis_equals_numpy_on_another_table(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 1)) * [2.0, -1.5, 0.5] + rng.normal(size=(200, 3)) * 0.3
    table = np.column_stack([x, np.full(200, 4.0), -x[:, 0] + rng.normal(size=200)])
    names = ["a", "b", "c", "flat", "along"]
    df = spark.createDataFrame([*map(tuple, table.tolist()), (None, 1.0, 1.0, 4.0, 9.0)], ", ".join(f"{n} double" for n in names))
    axis = style.fit_axis(df, names[:4], "along")
    z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.zeros(200)])
    v = np.linalg.svd(z, full_matrices=False)[2][0]
    scores = z @ v
    v = v * np.sign(np.corrcoef(scores, table[:, 4])[0, 1])
    other = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0), (None, 2.0, 3.0, 5.0)], "a double, b double, c double, flat double")
    got = [r.s for r in other.select(axis.score(names[:4]).alias("s")).collect()]
    assert abs(got[0] - ((np.array([1, 2, 3]) - x.mean(axis=0)) / x.std(axis=0)) @ v[:3]) < 1e-9 and got[1] is None
    with pytest.raises(ValueError):
        style.fit_axis(df.where("false"), names[:4], "along")


def test_registered_probe_and_axis(spark):
    assert catalog.style_probe(spark, SMALL).count() == 4
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").select("vec_id", F.slice("embedding", 1, 8).alias("x")).collect()
    even, odd = ([r for r in rows if r.vec_id % 2 == k] for k in (0, 1))
    x = np.array([r.x for r in even], np.float64)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    v = np.linalg.svd(z, full_matrices=False)[2][0]
    v = v * np.sign(np.corrcoef(z @ v, x[:, 0])[0, 1])
    want = {r.vec_id: float((np.array(r.x, np.float64) - x.mean(axis=0)) / x.std(axis=0) @ v) for r in odd}
    got = {r.vec_id: r.score for r in catalog.style_axis(spark, SMALL).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4
