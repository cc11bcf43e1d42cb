"""The index's fit is spread over tasks, and blocks of tokens find the same centroids as all at once."""

from __future__ import annotations

import numpy as np

from quillon.operators import late_index


def test_centroids_are_fitted_over_more_than_one_part(spark, monkeypatch):
    parts = []

    class Told(late_index.KMeans):
        def fit(self, dataset):
            parts.append(sum(1 for n in dataset.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n))
            return super().fit(dataset)

    monkeypatch.setattr(late_index, "KMeans", Told)
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(k, rng.normal(size=(3, 4)).tolist()) for k in range(200)], "doc_id long, toks array<array<double>>")
    index = late_index.build(docs, cells=8)
    assert parts[0] > 1 and len(index.centroids) == 8 and index.codes.count() == 200


def test_blocks_of_tokens_find_the_nearest_centroids(monkeypatch):
    rng = np.random.default_rng(4)
    tokens, centroids = rng.normal(size=(103, 5)), rng.normal(size=(7, 5))
    want = ((tokens[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1).tolist()
    for scores in (1, 70, 1 << 22):
        monkeypatch.setattr(late_index, "SCORES", scores)
        assert late_index.nearest(tokens, centroids).tolist() == want
    assert late_index.nearest(tokens[:0], centroids).tolist() == []
