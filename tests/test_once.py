"""What a row needs is worked out once: plans name costly steps and sources no oftener than results ask for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import attributes, documents, retrieval, structures

TOKENS = "array<struct<i:int,head:int,dep:string,text:string,is_punct:boolean,is_space:boolean>>"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_picked_attributes_squeeze_each_value_a_fixed_number_of_times(spark):
    slots = [(f"A{k}", F.array(F.col("v"))) for k in range(8)]
    plan = optimized(spark.createDataFrame([("x",)], "v string").select(documents.picked_attributes(slots).alias("p")))
    assert plan.count("regexp_replace") <= 10


def test_uses_and_quality_words_are_sought_in_one_text(spark):
    rows = spark.createDataFrame([("t", "a premium tool, used for camping", ["f"])], "title string, description string, features array<string>")
    both = rows.select(
        attributes.use_case(F.col("title"), F.col("description"), F.col("features"), attributes.Category()).alias("u"),
        attributes.description_words(F.col("description"), attributes.QUALITY).alias("q"),
    )
    assert both.first()[:] == ("Camping", ["Premium"])
    plan = optimized(both)
    assert plan.count("regexp_extract") == 1 and plan.count("<[^>]+>") == 2


def test_user_structures_read_their_texts_once(spark):
    rows = [(1, [(0, 0, "ROOT", "go", False, False), (1, 0, "acl", "seen", False, False), (2, 1, "mark", "that", False, False), (3, 1, "conj", "run", False, False)]), (2, [(0, 0, "ROOT", "x", False, False)])]
    texts = spark.createDataFrame(rows, f"user_id int, tokens {TOKENS}")
    found = structures.user_structures(texts)
    got = {r.user_id: r for r in found.collect()}
    assert (got[1].texts, got[1].words, got[1].structures, got[1].mean_gap, got[1].median_gap) == (1, 4, 3, 0.0, 0.0)
    assert got[1].kinds == {"acl": 2, "conj": 1} and got[1].markers == {"that": 2}
    assert (got[2].structures, got[2].ratio, got[2].mean_gap, got[2].words_per_structure, got[2].kinds, got[2].markers) == (0, 0.0, None, None, {}, {})
    assert optimized(found).count("LogicalRDD") + optimized(found).count("LocalRelation") == 1


def test_personal_boost_reads_candidates_once(spark):
    candidates = spark.createDataFrame([("q", 1, 10, 1.0), ("q", 1, 11, 1.0), ("r", 2, 10, 1.0)], "query_id string, user_id int, doc_id int, score double")
    wishes = spark.createDataFrame([(1, "Red", "REQUIRED"), (1, "cup", "RELEVANT"), (1, "", "REQUIRED")], "user_id int, value string, relevance string")
    found = retrieval.personal_boost(candidates, wishes, spark.createDataFrame([(1, 11), (1, 11)], "user_id int, doc_id int"), spark.createDataFrame([(10, "A red CUP")], "doc_id int, text string"))
    got = {(r.query_id, r.doc_id): r.score for r in found.collect()}
    assert got == {("q", 10): 1.09, ("q", 11): 1.045, ("r", 10): 1.0}
    assert optimized(found).count("Join") == 3
