from __future__ import annotations

import hashlib

import corpus_pipeline
import duckdb
import pyarrow as pa
from compare import SMALL, differences
from test_operators import COLUMNS, ascii_lower, classes, corpus, plain_repeats, words

from pyspark.sql import functions as F

from quillon.llm import bpe, langid, mixing, simhash, suffix_dedup
from quillon.llm.queries import oracle_sql, queries


def test_queries_with_sql_agree(spark):
    for name, sql in oracle_sql().items():
        assert differences(spark, name, queries()[name], sql) == ""


def placed(row):
    return row[0] is None, row[0] or 0


def first_of_near_copies(rows):
    """Of rows (id, text) the first of each group linked by five-word Jaccard similarity of 0.8 or more."""
    rows = sorted(rows, key=placed)
    sets = []
    for _, text in rows:
        w = words(ascii_lower(text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    near = [(a, b) for b in range(len(rows)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    roots = classes(range(len(rows)), near)
    return [rows[k] for k in range(len(rows)) if roots[k] == k]


def test_run_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [r[:5] for r in corpus()]
    rows += [((1 << 60) + 1, rows[3][1] + " and a tail of its own", "en", "s1", 9), (None, "no id but the of and with words", None, None, None), (None, rows[3][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("cut_spans", F.lit("x")).withColumn("mix_source", F.lit("y"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    told = {(r[0], r[1]): r for r in rows}
    left = first_of_near_copies([r[:2] for r in rows if any(c.isalpha() for c in r[1] or "")])
    kept = []
    for (d, text), (_, gone) in zip(left, plain_repeats(left, 50), strict=True):
        spans = [{"first": k, "until": k + 1} for k in sorted(gone)]
        now = suffix_dedup.without_spans(text, spans) if gone else text
        if now.strip() or not gone:
            kept.append((d, now, *told[d, text][2:4]))
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang", "source"), map(list, zip(*kept, strict=True)), strict=True))))
    sampled = {r[0] for r in con.sql(f"SELECT doc_id FROM ({oracle_sql()['op6_mixing']}) WHERE sampled").fetchall()}
    library = Tokenizer.from_file(bpe.public_vocabulary())
    want = []
    for d, text, *_ in kept:
        if d in sampled:
            ids = library.encode(text, add_special_tokens=False).ids
            want.append((d, len(ids), ids, hashlib.sha256(text.encode()).hexdigest()))
    assert 20 < len(want) < len(kept) and got == sorted(want, key=repr)


def test_stages_keep_the_columns_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "s", 0), (10_002, "12 !", None, "s", 4)], docs.schema)
    docs = docs.union(odd)
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if stage is langid.keep_identified:
            assert set(before) - set(after) == {d for d, r in before.items() if not any(c.isalpha() for c in r.text or "")}
        if stage is simhash.keep_first:
            assert set(after) == {before_id for before_id, _ in first_of_near_copies([(d, r.text) for d, r in before.items()])}
        if stage is not suffix_dedup.cut_stage and number < 4:
            assert all(after[d] == before[d] for d in after)
        if stage is mixing.sample_stage:
            assert 0.5 * len(before) < len(after) <= len(before)
        if stage is bpe.encode_stage:
            assert all(len(r.ids) == r.n_tokens for r in after.values()) and set(after) == set(before)


def test_empty_corpus_runs_through(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
