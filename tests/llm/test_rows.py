"""Rows without ids, of one id, of ids over 2**53 beside nulls, of clashing columns, and of very long texts: each judged by its own text."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from test_operators import ascii_lower, plain_statistics, words

from quillon.llm import bpe, langid, license, media, mixing, quality_rules, rule_ensemble, simhash, suffix_dedup, url_rules

WIDE = (1 << 60) + 1
LONG = " ".join(f"word{k % 70_001}" for k in range(90_000))
ROWS = [
    (5, "all rights reserved"),
    (5, "cc by foo all rights reserved"),
    (None, "all rights reserved hello"),
    (None, "quite plain words of a text"),
    (WIDE, "some more words, and the general public license"),
    (WIDE + 1, None),
    (7, LONG),
    (7, "twice"),
    (7, "twice"),
]
CLASHES = ("h", "k", "w", "d", "row", "fp", "spans", "cut_spans", "cut_doc", "mix_source", "mix_words", "weight", "probability", "id", "key", "bands", "label", "llr", "topic")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en" if k % 2 else None, "s", k) for k, (d, t) in enumerate(ROWS)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return made.select("*", *(F.lit("clash").alias(c) for c in CLASHES)).coalesce(1).cache()


def in_order(found):
    return sorted(found, key=repr)


def ids(found):
    return in_order(r.doc_id for r in found)


def test_license_scan_of_each_row(docs):
    got = license.scan(docs).collect()
    want = []
    for d, text in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        at = sorted((i, label) for phrase, label in license.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        want.append((d, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert in_order((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == in_order(want)


def test_quality_ratio_of_each_row(spark, docs):
    trusted = docs.where("doc_id = 7")
    got = quality_rules.judge(docs, trusted, buckets=64, prior=5.0).collect()
    texts = [t for _, t in ROWS]
    grams = sorted({g for t in texts for g in plain_grams(t)}, key=repr)
    hashed = spark.createDataFrame(grams, "a string, b string")
    u, v = quality_rules.bucket(F.col("a"), buckets=64), quality_rules.bucket(F.col("a"), F.col("b"), buckets=64)
    bucket = {(r.a, r.b): r.x for r in hashed.select("a", "b", F.when(F.col("b").isNull(), u).otherwise(v).alias("x")).collect()}
    weight = {r.bucket: r.weight for r in quality_rules.weights(docs, trusted, 64, 5.0).collect()}
    want = []
    for d, text in ROWS:
        own = [weight[bucket[g]] for g in plain_grams(text)]
        want.append((d, len(words(text)), plain_statistics(text)[4], round(sum(own) / len(own) / 1e6, 9) if own else 0.0))
    assert in_order((r.doc_id, r.n_words, r.n_repeat_words, round(r.llr, 9)) for r in got) == in_order(want)


def plain_grams(text):
    w = words(text)
    return [(a, None) for a in w] + list(zip(w, w[1:], strict=False))


def test_ids_pass_every_operator(spark, docs):
    want = in_order(d for d, _ in ROWS)
    model = langid.fit(docs)
    assert ids(langid.identify(docs, model).collect()) == want
    assert ids(simhash.fingerprints(docs).collect()) == want == ids(simhash.near_duplicates(docs).collect())
    assert ids(suffix_dedup.repeats(docs).collect()) == want
    assert ids(bpe.tokenize(docs, bpe.public_vocabulary(), outputs=("n_tokens",)).collect()) == want
    assert ids(rule_ensemble.with_statistics(docs).collect()) == want
    assert ids(media.sequences(media.pages_of(docs), "doc_id").select("doc_id").collect()) == want
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.example.org/"), "text").alias("url"))
    assert in_order(r.page_id for r in url_rules.judge(pages, []).collect()) == want


def test_stages_keep_clashing_columns(spark, docs):
    kept = langid.keep_identified(spark, docs, "")
    assert kept.columns == docs.columns and in_order((r.doc_id, r.text) for r in kept.collect()) == in_order((d, t) for d, t in ROWS if t)
    first = simhash.keep_first(spark, docs, "")
    assert first.columns == docs.columns and in_order((r.doc_id, r.text) for r in first.collect()) == in_order(ROWS[:-1])
    cut = suffix_dedup.cut_stage(spark, docs, "")
    assert cut.columns == docs.columns and ids(cut.collect()) == in_order(d for d, _ in ROWS)
    sampled = mixing.sample_stage(spark, docs, "")
    assert sampled.columns == docs.columns and set(sampled.collect()) <= set(docs.collect())
    assert mixing.mix(mixing.described(docs, [("word", 1.0)])).count() == len(ROWS)


def test_conflicting_labels_and_null_ids_when_scoring(spark, docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    model = rule_ensemble.fit(docs, labels)
    scored = rule_ensemble.with_statistics(docs).select("doc_id", rule_ensemble.held_out().alias("h"), model.score().alias("s")).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.s <= 1 and r.h is not None for r in scored)


def test_many_languages(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}x" * 9, f"l{k:03d}") for k in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 200
    assert [x[0] for x in langid.label_texts(model, [r[1] for r in rows[150:160]])] == [r[2] for r in rows[150:160]]
    found = langid.viterbi([langid.np.eye(200)[[150, 150, 199]] * 50.0])
    assert found[0].tolist() == [150, 150, 199]
