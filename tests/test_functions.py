from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import errors as er
from quillon.functions import text as tx
from quillon.operators import attributes, evaluation, matching, profiles, syntax, tables
from quillon.sources import readers, writers
from quillon.streaming import appends


def one(spark, column, schema=None, **values):
    if schema is not None:
        return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("seconds", "told"), [(3661, "1h 1m 1s"), (125, "2m 5s"), (9, "9s")])
def test_duration(spark, seconds, told):
    assert one(spark, tx.duration(F.col("s")), s=seconds) == told


@pytest.mark.parametrize(("text", "price"), [("$1,299.00", "1299.00"), ("19.99 dollars", "19.99"), ("none", None), ("1,299 usd", "299")])
def test_price_in_text(spark, text, price):
    assert one(spark, tx.price_in_text(F.col("t")), t=text) == price


def test_attribute_identity(spark):
    assert one(spark, tx.attribute_identity(F.col("a")), a="19.90") == "NUM::19.9" == one(spark, tx.attribute_identity(F.col("a")), a=" 19.9")
    assert one(spark, tx.attribute_identity(F.col("a")), a="Red") == "TEXT::red"


def test_first_difference(spark):
    told = one(spark, tx.first_difference(F.col("a"), F.col("b")), a="I am looking for a Small unit", b="I am laying for a Small unit")
    assert (told.correct_word, told.error_word) == ("looking", "laying")
    assert one(spark, tx.first_difference(F.col("a"), F.col("b")), a="a b", b="a") is None


@pytest.mark.parametrize(
    ("original", "corrected", "told"),
    [("alot", "a lot", "space_diff"), ("its", "it's", "punct_only"), ("It's", "it", "punct_only"), ("was", "were", "verb_variation"), ("i", "me", "pronoun_variation"),
     ("dog", "dogs", "affix_variation"), ("laying", "looking", ""), ("a", "A", "identity"), ("", "x", "empty"), ("a b", "c d", "multi_word")],
)
def test_pair_class(spark, original, corrected, told):
    assert one(spark, er.pair_class(F.col("a"), F.col("b")), a=original, b=corrected) == told


def test_letter_predicates(spark):
    ask = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert ask(er.is_transposition, "form", "from") and not ask(er.is_transposition, "form", "form")
    assert ask(er.is_visually_similar, "bog", "dog") and not ask(er.is_visually_similar, "cat", "dog")
    assert ask(er.is_keyboard_slip, "cat", "vat") and not ask(er.is_keyboard_slip, "cat", "pat")
    assert ask(er.error_type, "recieve", "receive") == "phonetic"


def test_replace_first_is_letter_bounded(spark):
    assert one(spark, er.replace_first(F.col("t"), F.lit("cat"), F.lit("kat")), t="concat Cat cat") == "concat kat cat"


def test_injection_takes_the_first_matching_token(spark):
    queries = spark.createDataFrame([(1, 7, "a small box"), (2, 7, "zzz"), (3, 8, "small")], "query_id int, user_id int, text string")
    history = spark.createDataFrame([(7, [("smlal", "small")])], "user_id int, errors array<struct<original:string,corrected:string>>")
    got = {r.query_id: (r.noisy_query, r.status) for r in profiles.inject(queries, history).collect()}
    assert got == {1: ("a smlal box", "rewritten"), 2: ("zzz", "no_match"), 3: ("small", "no_match")}


def test_single_target_metrics(spark):
    ranked = spark.createDataFrame([(1, 9, 1), (1, 5, 3)], "query_id int, doc_id int, rank int")
    row = evaluation.single_target(ranked, spark.createDataFrame([(1, 5)], "query_id int, doc_id int")).first()
    assert (row.h_at10, row.n_at10, row.mrr_at10, row.h_at1) == (1.0, 0.5, pytest.approx(1 / 3), 0.0)


def test_distribution_tails():
    assert evaluation._beta(5, 0.5, 10 / (10 + 2.228**2)) == pytest.approx(0.05, abs=1e-4)
    assert evaluation._gamma_tail(1.0, 5.991 / 2) == pytest.approx(0.05, abs=1e-4)


def test_clause_features():
    found = dict(zip(syntax.FEATURES, syntax.clause_features([0, 0, 1, 2, 3], ["root", "acl", "relcl", "amod", "x"]), strict=True))
    assert found["max_dependency_depth"] == 4 and found["dependency_tree_height"] == 5 and found["clause_nesting_depth"] == 2
    assert found["max_branching_factor"] == 1 and found["mean_dependency_distance"] == 1
    assert syntax.clause_features([], []) == [0.0] * 20


def test_matching_uses_each_product_once(spark):
    edges = [(u, p) for u in range(12) for p in range(12) if (u * p) % 5 in (1, 2)]
    got = matching.match(spark.createDataFrame(edges, "user_id int, asin int"), capacity=2).collect()
    assert len({r.asin for r in got}) == len(got) and all(sum(r.user_id == u for r in got) <= 2 for u in range(12))
    held, full = {r.asin for r in got}, {u for u in range(12) if sum(r.user_id == u for r in got) == 2}
    assert all(p in held or u in full for u, p in edges)


def test_expectations(spark):
    rows = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="k unique"):
        tables.require_unique(rows, ["k"]).collect()
    assert tables.require(rows, "positive", F.col("k") > 0).count() == 2


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        f.write('{"user_id":"u","asin":"a","reviewText":"t","vote":"1,234"}\nbroken\n{"user_id":null,"asin":"a","text":"x"}\n')
    got = readers.reviews(spark, str(tmp_path / "r.json.gz")).collect()
    assert [(r.user_id, r.text, r.vote) for r in got] == [("u", "t", 1234)]
    (tmp_path / "p.json").write_text(json.dumps({"parent_asin": "p", "title": "t", "details": json.dumps({"Brand": "B"}), "features": ["f"]}) + "\n")
    row = readers.products(spark, str(tmp_path / "p.json")).first()
    assert (row.key, row.brand, row.features) == ("p", "B", ["f"])
    (tmp_path / "q.json").write_text("{'asin':'a','question':'q?','answer':'y'}\n{'asin':'a','question':'q2','answer':''}\n")
    assert [len(r.qa) for r in readers.questions(spark, str(tmp_path / "q.json")).collect()] == [1]
    (tmp_path / "c.txt").write_text('{"a":1}{"a":2}\n[{"a":3}]')
    assert [r.a for r in readers.records(readers.concatenated_json(spark, str(tmp_path / "c.txt")), "struct<a:int>").orderBy("ordinal").collect()] == [1, 2, 3]
    (tmp_path / "d.txt").write_text('{"a":1}{"a":')
    assert readers.concatenated_json(spark, str(tmp_path / "d.txt"), salvage=True).count() == 1


def test_model_response(spark):
    schema = "struct<status:string,n:struct<x:int>>"
    for text in ('```json\n{"status":"ok","n":{"x":1}}\n```', 'said {"status":"ok","n":{"x":1}'):
        told = one(spark, readers.model_response(F.col("t"), schema), t=text)
        assert told.status == "ok" and told.n.x == 1


def test_collection_tsv(spark, tmp_path):
    writers.collection_tsv(spark.createDataFrame([(5, "a\tb"), (2, "c\nd")], "doc_id long, text string"), str(tmp_path / "c"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == ["0\tc d", "1\ta b"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, k, f"v{k}") for k in range(12)], "key int, ordinal int, v string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    source = appends.stream(spark, str(tmp_path / "in"), rows, 1)
    appends.upsert_last(source, ["key"], "ordinal", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name))
    assert sorted((r.key, r.ordinal) for r in spark.read.parquet(str(last)).collect()) == [(0, 9), (1, 10), (2, 11)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    counted = appends.windowed_counts(appends.stream(spark, str(tmp_path / "ev"), events), "ts", "event_type")
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").start().processAllAvailable()
    assert spark.sql("select sum(n) from counted").first()[0] == events.count()
    for q in spark.streams.active:
        q.stop()


def test_product_type_takes_the_longest_part(spark):
    for categories, want in ((["a", "Pots & Frying Pans & Lids."], "Frying Pans"), (["Cups", "x"], "Cups"), (["Toys!："], "Toys"), (["ok", "...."], None), ([], None)):
        assert one(spark, tx.product_type(F.col("t")), "t array<string>", t=categories) == want


@pytest.mark.parametrize(
    ("title", "description", "features", "want"),
    [
        ("Mug for kids and painting", "", None, "Kids"),  # eight letters each, the one that the list has first
        ("A <b>wedding</b> gift", None, [], "Wedding"),
        ("Tray", "be used  for soap, and more", None, "Soap Making"),
        ("Tray", "used for various things", None, None),
        ("Tray", "used for grinding", ["for diaper changing"], "Diaper changing"),
        ("Tray", "used for grinding", None, "Grinding"),
        (None, None, None, None),
    ],
)
def test_use_case(spark, title, description, features, want):
    column = attributes.use_case(F.col("title"), F.col("description"), F.col("features"), attributes.Category())
    assert one(spark, column, "title string, description string, features array<string>", title=title, description=description, features=features) == want


@pytest.mark.parametrize(
    ("description", "quality", "appearance"),
    [
        ("A <b>Top  Quality</b> cup, finest GREEN glass", ["Top quality", "Fine"], ["Green"]),
        ("heavy<br>duty, transparent steel", ["Heavy duty"], ["Transparent"]),
        ("best of <i>all</i> cups", [], []),
        ("best of all the cups", ["Best"], []),
        ("", [], []),
        (None, [], []),
    ],
)
def test_description_words(spark, description, quality, appearance):
    found = [one(spark, attributes.description_words(F.col("d"), words), "d string", d=description) for words in (attributes.QUALITY, attributes.APPEARANCE)]
    assert found == [quality, appearance]


def test_product_attributes_say_why_they_reject(spark):
    ddl = "asin string, parent_asin string, title string, brand string, price string, category array<string>, categories array<string>, features array<string>, description string, details string"
    full = dict(asin="a", parent_asin=None, title="Cup", brand="Acme", price="$1,299.", category=["Cups"], categories=None, features=None, description="Sturdy; BPA-free, safe cup for baby", details='{"Size": " L ", "Age Range Description": "2+"}')
    rows = [full, full | {"asin": "", "parent_asin": None}, full | {"brand": None}, full | {"brand": " Generic "}, full | {"category": []}, full | {"price": ""}, full | {"description": None, "details": "bad"}, full | {"asin": None, "parent_asin": "p", "brand": "", "details": '{"Brand": "B"}', "category": None, "categories": ["x", "Bibs"], "price": None, "title": "Bib 5 dollars"}]
    got = attributes.product_attributes(spark.createDataFrame(rows, ddl)).collect()
    assert [r.reason for r in got] == [None, "no_asin", "no_brand", "invalid_brand", "no_category", "no_price", "few_slots", None]
    first, last = got[0], got[-1]
    assert (first.A1_product_type, first.A3_price, first.A5_use_case, first.A6_detailed) == ("Cups", "1299", "Baby", {"age_range": "2+", "size": "L"})
    assert (first.A8_safety, first.A9_durability, first.A14_size, first.A16_compatibility) == (["Safe", "Bpa Free"], ["Sturdy"], ["L"], ["2+"]) and first.n_slots == 10
    assert first.A18_quality == ["Sturdy"] and got[6].A18_quality == []
    assert (last.asin, last.A1_product_type, last.A2_brand, last.A3_price) == ("p", "Bibs", "B", "5")
