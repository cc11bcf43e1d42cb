"""Lexical searches keep postings inside their tasks, whatever blocks they score by."""

from __future__ import annotations

import pytest

from quillon.operators import retrieval

DOCS = [(k, " ".join(f"w{(k * j) % 13}" for j in range(1, 3 + k % 5))) for k in range(40)] + [(98, ""), (99, None), (None, "w1 w2 w2")]
QUERIES = [(1, "w1 w2 w2"), (2, "W3 nowhere"), (3, "nowhere"), (4, None), (5, "w0 w1 w5 w7")]


@pytest.mark.parametrize("search", [retrieval.bm25, retrieval.dirichlet, retrieval.tfidf, retrieval.term_dot])
def test_blocks_change_nothing_and_no_posting_is_shuffled(spark, monkeypatch, search):
    docs, queries = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(QUERIES, "query_id int, text string")
    want = search(docs, queries, k=7).collect()
    assert {r.query_id for r in want} == {1, 2, 5} and max(r["rank"] for r in want) == 7
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 2)
    monkeypatch.setattr(retrieval, "CELLS", 9)
    found = search(docs, queries, k=7)
    assert sorted(found.collect(), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortMergeJoin" not in plan
    assert search(docs.limit(0), queries).count() == 0 and search(docs, queries.limit(0)).count() == 0


def test_dot_equals_plain_python(spark):
    docs, queries = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(QUERIES, "query_id int, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.term_dot(docs, queries, k=100).collect()}
    want = {}
    for q, a in QUERIES:
        for d, b in DOCS:
            total = sum((a or "").lower().split().count(w) * (b or "").split().count(w) for w in set((a or "").lower().split()))
            if total:
                want[q, d] = float(total)
    assert got == want


def test_ann_scores_probed_cells_alone_and_joins_nothing_by_cell(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(60, 4)).round(3).tolist()
    docs = spark.createDataFrame(list(enumerate(vecs)), "doc_id long, vec array<double>")
    queries = docs.where("doc_id < 7").withColumnRenamed("doc_id", "query_id")
    every = {(r.query_id, r.doc_id): r["rank"] for r in retrieval.dense(docs, queries, k=5).collect()}
    found = retrieval.ivf(docs, queries, k=5, cells=4, probes=4)
    assert {(r.query_id, r.doc_id): r["rank"] for r in found.collect()} == every
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    one = retrieval.ivf(docs, queries, k=60, cells=4, probes=1).collect()
    assert {r.query_id for r in one} == set(range(7)) and all(r.doc_id < 60 for r in one) and len(one) < 7 * 60
    assert retrieval.ivf(docs, queries.limit(0), cells=4).count() == 0


def test_known_sizes_leave_the_metrics_as_they_are(spark):
    from quillon.operators import evaluation

    ranked = spark.createDataFrame([(q, (q * 7 + r * 3) % 20, r) for q in range(5) for r in range(1, 11)], "query_id int, doc_id int, rank int")
    relevant = spark.createDataFrame([(q, d) for q in range(5) for d in range(q, 20, 3)], "query_id int, doc_id int")
    sizes = relevant.groupBy("query_id").agg({"doc_id": "count"}).toDF("query_id", "r")
    within = relevant.join(ranked, ["query_id", "doc_id"], "left_semi")
    assert sorted(evaluation.relevant_sets(ranked, within, sizes=sizes).collect()) == sorted(evaluation.relevant_sets(ranked, relevant).collect())
