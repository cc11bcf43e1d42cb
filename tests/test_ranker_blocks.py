"""The ranker judges a user's tokens by blocks and trains on bins, one pass a level."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import ranker


def test_a_distinct_token_of_a_block_is_judged_once(spark, monkeypatch):
    errors = spark.createDataFrame([(1, "hte", "the"), (1, "TT2é", "t2t"), (2, "ß-x", "x")], "user_id int, original string, corrected string")
    profiles = ranker.user_profiles(errors)
    rows = [(k, 1 + k % 3, None if k == 7 else ["The", "hte", f"t{k % 2}", "xX"] if k else []) for k in range(30)]
    groups = spark.createDataFrame(rows, "group_id int, user_id int, tokens array<string>")
    plain = groups.join(profiles, "user_id").select("group_id", "user_id", "tokens", F.transform("tokens", lambda w: ranker.token_features(w)).alias("x"))
    want = sorted(plain.collect(), key=str)
    for size, piece in ((4096, 256), (3, 2)):
        monkeypatch.setattr(ranker, "GROUPS", size)
        monkeypatch.setattr(ranker, "PIECE", piece)
        found = ranker.featured(groups, profiles)
        assert found.columns == [*groups.columns, "x"] and sorted(found.collect(), key=str) == want
    # A profile meets blocks of groups, so a user's words aren't repeated for each of the groups.
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_tree_takes_one_pass_a_level_over_bins(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, np.round(rng.normal(size=(n, 3)), 2).tolist(), [1, *[0] * (n - 1)]) for k, n in enumerate(rng.integers(1, 7, 200).tolist())]
    groups = spark.createDataFrame(rows, "group_id long, x array<array<double>>, y array<int>")
    read, passes = [], ranker.histogram
    monkeypatch.setattr(ranker, "histogram", lambda rows, *rest: read.append(dict(rows.dtypes)["x"]) or passes(rows, *rest))
    model = ranker.train(groups, rounds=2, depth=2, rate=0.5)
    assert read == ["binary"] * 4
    # The same trees, level by level over values, leaves by a pass of their own.
    edges, values, trees = ranker.bin_edges(groups), groups.withColumn("s", F.transform("y", lambda _: F.lit(0.0))), []
    for _ in range(2):
        tree = ranker.Tree((), (), (0.0,))
        for _ in range(2):
            splits = [ranker.best_split(node, 1.0, 5) for node in passes(values, trees, tree, edges)]
            tree = ranker.Tree(tree.feature + tuple(s[0] if s else 0 for s in splits), tree.bound + tuple(float(edges[s]) if s else float("inf") for s in splits), (0.0,) * 2 * len(tree.leaf))
        whole = passes(values, trees, tree, edges)[:, 0].sum(axis=1)
        trees.append(ranker.Tree(tree.feature, tree.bound, tuple((0.5 * whole[:, 0] / (whole[:, 1] + 1.0)).tolist())))
    assert model.trees == tuple(trees)
    monkeypatch.setattr(ranker, "FOLD", 1)
    assert ranker.train(groups, rounds=2, depth=2, rate=0.5) == model


def test_edges_are_quantiles_however_rows_are_dealt(spark, monkeypatch):
    x = np.round(np.random.default_rng(2).normal(size=(600, 2)) ** 3, 2)
    rows = spark.createDataFrame([(part.tolist(),) for part in np.split(x, 60)], "x array<array<double>>")
    found = [ranker.bin_edges(rows.repartition(n), 8) for n in (1, 7)]
    want = np.sort(x, axis=0)[np.ceil(np.arange(1, 8) * 600 / 8).astype(int) - 1].T
    assert np.array_equal(found[0], want) and np.array_equal(found[1], want)
    # Summaries are bounded, and off by no more than their shares.
    values, counts = ranker._summary(x[:, 0], np.ones(600, np.int64), 50)
    assert len(values) <= 50 and counts.sum() == 600
    assert all(abs((x[:, 0] <= v).sum() - c) == 0 for v, c in zip(values, np.cumsum(counts), strict=True))
