from __future__ import annotations

import math

import numpy as np
import pytest
from compare import SMALL
from pyspark.sql import functions as F

from quillon.operators import ranker
from quillon.plans import catalog


def plain_lambdas(scores, y):
    """One group's gradients, pair by pair."""
    n = len(y)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    rank = {i: r for r, i in enumerate(order)}
    ideal = sum((2**v - 1) / math.log2(r + 2) for r, v in enumerate(sorted(y, reverse=True)))
    g, h = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if y[i] > y[j]:
                change = (2 ** y[i] - 2 ** y[j]) * abs(1 / math.log2(rank[i] + 2) - 1 / math.log2(rank[j] + 2)) / ideal
                rho = 1 / (1 + math.exp(scores[i] - scores[j]))
                g[i] += rho * change
                g[j] -= rho * change
                h[i] += rho * (1 - rho) * change
                h[j] += rho * (1 - rho) * change
    return g, h


def test_gradients_equal_those_pair_by_pair():
    rng = np.random.default_rng(3)
    sizes = np.array([4, 1, 7, 3, 5])
    scores, y = np.round(rng.normal(size=20), 1), rng.integers(0, 3, 20).astype(float)
    y[:4] = 1
    g, h = ranker.lambdas(scores, y, sizes)
    at = 0
    for n in sizes:
        want = plain_lambdas(scores[at : at + n].tolist(), y[at : at + n].tolist())
        assert np.allclose(g[at : at + n], want[0]) and np.allclose(h[at : at + n], want[1])
        at += n
    assert np.all(g[:5] == 0)


def groups_of(spark, n, seed):
    """Groups whose relevant token has the greatest value of feature 1, which feature 0 hides."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x = np.round(rng.normal(size=(rng.integers(2, 9), 3)), 3)
        rows.append((k, x.tolist(), (np.arange(len(x)) == (x[:, 1] - 0.1 * x[:, 0]).argmax()).astype(int).tolist()))
    return spark.createDataFrame(rows, "group_id long, x array<array<double>>, y array<int>")


def test_histogram_equals_brute_force_however_rows_are_dealt(spark):
    rows = groups_of(spark, 40, 5).withColumn("s", F.transform("y", lambda _: F.lit(0.0)))
    edges = ranker.bin_edges(rows, 8)
    tree = ranker.Tree((1,), (0.0,), (0.0, 0.0))
    found = [ranker.histogram(rows.repartition(n), [], tree, edges) for n in (1, 5)]
    want = np.zeros_like(found[0])
    for r in rows.collect():
        g, h = plain_lambdas([0.0] * len(r.y), r.y)
        for x, gi, hi in zip(r.x, g, h, strict=True):
            for f in range(3):
                want[int(x[1] > 0), f, np.searchsorted(edges[f], x[f])] += gi, hi, 1
    assert np.array_equal(found[0], found[1]) and np.allclose(found[0], want, atol=1e-5)


def test_trees_rank_unseen_groups_better_than_one_feature(spark):
    model = ranker.train(groups_of(spark, 400, 1), rounds=10, depth=3, rate=0.3)
    unseen = groups_of(spark, 200, 2)
    mean = lambda s: ranker.ndcg(unseen.withColumn("s", s)).agg(F.avg("ndcg")).first()[0]
    learned = mean(F.transform("x", model.score))
    assert learned > 0.93 and learned > mean(F.transform("x", lambda x: x[0])) + 0.2
    row = unseen.withColumn("s", F.transform("x", model.score)).first()
    assert np.allclose(row.s, model.predict(np.array(row.x)))


def test_training_without_rows_raises(spark):
    with pytest.raises(ValueError):
        ranker.train(groups_of(spark, 1, 1).where("false"))


def test_training_groups_and_features(spark):
    errors = spark.createDataFrame([(1, "u", "teh", "The", "Buy teh Red2 shoe now 42 a"), (2, "u", "abc", "xyz", "no such word"), (3, "v", "", "x", "y")], "group_id long, user_id string, original string, corrected string, span_text string")
    found = ranker.training_groups(errors, stop_words=("now",)).collect()
    assert [(r.group_id, r.tokens, r.y) for r in found] == [(1, ["Buy", "The", "Red2", "shoe"], [0, 1, 0, 0])]
    x = ranker.featured(ranker.training_groups(errors), ranker.user_profiles(errors), {"colors": ["red2"]}).first().x
    at = dict(zip(ranker.FEATURES, x[2], strict=True))
    assert (at["is_color"], at["is_brand"], at["has_digit"], at["has_upper"], at["token_len"], at["vowel_ratio"], at["user_error_rate"]) == (1, 1, 1, 1, 4, 0.25, 0.2)
    assert at["spelling_ratio"] + at["phonetic_ratio"] + at["visual_ratio"] <= 1 and at["has_double_letter"] == 0


def test_injection_of_the_likeliest_error(spark):
    errors = spark.createDataFrame([("u", "shoo", "shoe")], "user_id string, original string, corrected string")
    history = errors.groupBy("user_id").agg(F.collect_list(F.struct("original", "corrected")).alias("errors"))
    queries = spark.createDataFrame([(1, "u", "a red stereo"), (2, "u", "1 2"), (3, "w", "plain words"), (4, "u", "tall one")], "query_id long, user_id string, text string")
    long_first = ranker.Ranker((ranker.Tree((15,), (4.0,), (0.0, 1.0)),))
    found = {r.query_id: r for r in ranker.injected(queries, ranker.user_profiles(errors), history, long_first).collect()}
    assert (found[1].selected_token, found[1].noisy_query, found[1].query_rewritten, found[1].status) == ("stereo", "a red shoo", True, "success")
    assert found[2].status == found[3].status == "skipped" and found[2].noisy_query == "1 2"
    assert found[4].selected_token == "tall" and not found[4].query_rewritten


def test_registered_ranker_beats_weighted_scores_on_unseen_turns(spark):
    found = catalog.token_ranker(spark, SMALL).collect()
    learned = sum(r.ndcg for r in found) / len(found)
    errors = catalog._written_errors(spark, SMALL).withColumn("fold", F.crc32(F.col("group_id").cast("binary")) % 5)
    scored = ranker.featured(ranker.training_groups(errors.where("fold = 0")), ranker.user_profiles(errors.where("fold >= 3")))
    weighted = scored.withColumn("s", F.transform("x", lambda x: 0.3 * x[0] + 0.2 * x[1] + 0.2 * x[2] + 0.15 * x[3] + 0.15 * x[4]))
    assert learned > ranker.ndcg(weighted).agg(F.avg("ndcg")).first()[0] + 0.3 and learned > 0.7


def test_similarities_equal_the_column_expression_and_features_do_too(spark):
    profiles = spark.createDataFrame(
        [(1, ["hte", "ß-x", ""], {"h": 2, "t": 5}, {"ht": 3}, 4, 0.5, 0.25, 0.25), (2, [], {}, {}, 1, 0.0, 0.0, 1.0)],
        "user_id int, error_words array<string>, char_freq map<string,bigint>, bigram_freq map<string,bigint>, n_errors bigint, phonetic_ratio double, visual_ratio double, spelling_ratio double",
    )
    groups = spark.createDataFrame([(k, 1 + k % 2, ["The", "hte", f"t{k}", "xX"] if k else []) for k in range(9)], "group_id int, user_id int, tokens array<string>").coalesce(1)
    found = ranker.featured(groups, profiles)
    plain = groups.join(profiles, "user_id").select("group_id", F.transform("tokens", lambda w: ranker.token_features(w)).alias("x"))
    assert dict(found.select("group_id", "x").collect()) == dict(plain.collect())
    # Turns are dealt over tasks, and words compared in blocks.
    plan = found._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning" in plan and "ArrowEvalPython" in plan
