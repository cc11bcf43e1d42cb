from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import documents, evaluation, retrieval

SCHEMA = """asin string, title string, brand string, rank string, description string, feature array<string>, reviews array<struct<summary:string,text:string,vote:string>>,
qa array<struct<question:string,answer:string>>, also_buy array<string>, also_view array<string>"""


def built(spark, rows, **options):
    return {r.asin: r.document for r in documents.product_documents(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_document_of_nulls_and_of_all_parts(spark):
    rows = [("a", *[None] * 9), ("b", "Cup", "Acme", "Product Dimensions: 1 x 2 x 3 in ; 5 lbs", "Weight: 3.5", ["<i>Hot</i>", "ASIN: 1", ""], [("s", "old", None), ("t", "q&amp;a", "1,200"), (None, "x", "many")], [("why?", None)], ["z", "a"], [])]
    got = built(spark, rows)
    assert got["a"] == "- product: Unnamed Product\n"
    assert got["b"] == (
        "- product: Cup\n- brand: Acme\n- dimensions: 1 x 2 x 3 in\n- weight: 3.5\n- description: Weight: 3.5\n- features: \n#1: Hot\n"
        '- reviews: The review "t" states that "q&a". The review "s" states that "old". The review "" states that "x". \n'
        '- Q&A: The question is "why?", and the answer is "". \n- relations:\n  products also purchased: \n#2: Unknown\n  brand: Acme\n'
    )
    assert "relations" not in built(spark, rows, relations=False)["b"] and "review" not in built(spark, rows, entries=0)["b"]
    assert "\n" not in built(spark, rows, compact=True)["b"]
    assert built(spark, []) == {}


def test_sizes_in_descriptions(spark):
    row = spark.sql("SELECT 'box 1.5 X 2 x 3 CM of 2 KG' AS d, CAST(NULL AS string) AS r")
    assert row.select(documents.dimensions(F.col("r"), F.col("d")), documents.weight(F.col("d"))).first()[:] == ("1.5 X 2 x 3 CM", "2 KG")


def test_picked_attributes_stop_at_five_and_skip_equal_values(spark):
    listed = [("A1", ["n/a", "Red (dark)"]), ("A2", ["red", "Blue, green"]), ("A3", None), ("A5", ["7.0"]), ("A6", ["7", "8"]), ("A7", ["c"]), ("A8", ["d"])]
    slots = [(k, F.array(*map(F.lit, v)) if v else F.lit(None).cast("array<string>")) for k, v in listed]
    got = spark.range(1).select(documents.picked_attributes(slots).alias("p")).first()["p"]
    assert [tuple(a) for a in got] == [("A1", "Red"), ("A2", "Blue"), ("A5", "7.0"), ("A6", "8"), ("A7", "c")]


@pytest.mark.parametrize(("mean", "depth"), [(2.5, 2), (3.5, 4), (0.4, None), (float("nan"), None), (float("inf"), None)])
def test_target_depth(spark, mean, depth):
    assert spark.createDataFrame([(mean,)], "m double").select(documents.target_depth(F.col("m"))).first()[0] == depth


def test_random_window_is_what_draws_tend_to(spark):
    docs = spark.createDataFrame([(k,) for k in range(12)], "doc_id long")
    got = {r.query_id: (r.p, r.n) for r in evaluation.random_window(spark.createDataFrame([(1, 0), (2, 3), (3, 11), (4, 99)], "query_id long, doc_id long"), docs).collect()}
    for query, doc in ((1, 0), (2, 3), (3, 11), (4, 99)):
        ranks = [doc - start + 1 for start in range(12) if start <= doc < min(start + 10, 12)]
        assert got[query] == pytest.approx((len(ranks) / 12, sum(1 / np.log2(r + 1) for r in ranks) / 12))


def test_searches_in_blocks_of_queries_equal_one_pass(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(k, rng.normal(size=4).tolist(), rng.normal(size=(1 + k % 3, 4)).tolist()) for k in range(40)], "doc_id long, vec array<double>, toks array<array<double>>")
    asked = docs.where("doc_id < 7").withColumnRenamed("doc_id", "query_id")
    for search in (retrieval.dense, retrieval.max_sim):
        parts, whole = (sorted(map(tuple, search(docs, asked, k=3, max_queries=m).collect())) for m in (3, 100))
        assert parts == whole and len(whole) == 21
        assert search(docs, asked.where("false"), k=3).collect() == []
    empty = docs.withColumn("toks", F.slice("toks", 1, F.when(F.col("doc_id") == 5, 0).otherwise(3)))
    got = retrieval.max_sim(empty, asked, k=40).collect()
    assert len(got) == 7 * 39 and all(r.doc_id != 5 for r in got)
    rows = {r.doc_id: r.toks for r in docs.collect()}
    for r in got:
        assert r.score == pytest.approx(sum(max(float(np.dot(q, d)) for d in rows[r.doc_id]) for q in rows[r.query_id]), abs=1e-5)
