"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import bpe, langid, license, media, mixing, quality_rules, rule_ensemble, simhash, suffix_dedup, url_rules
from quillon.llm.xxh import xxh64_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, n=80):
    """Texts with copies, near copies, shared passages, junk and odd cases."""
    rng = random.Random(seed)
    vocabulary = {"en": "the of and with that from".split(), "de": "der die das und nicht mit".split()}
    made = {lang: base + ["".join(rng.choice(base) for _ in range(2)) for _ in range(60)] for lang, base in vocabulary.items()}
    passage = " ".join(rng.choice(made["en"]) for _ in range(70))
    rows = []
    for k in range(n):
        lang = "en" if k % 3 else "de"
        text = " ".join(rng.choice(made[lang]) for _ in range(rng.randint(1, 160)))
        if k % 10 == 3:
            text += "\n" + passage + " tail" + str(k)
        if k % 10 == 5:
            text = rows[k - 5][1]
        if k % 10 == 6:
            text = " ".join(w + rng.choice("#*$%") * 3 for w in text.split())
        if k % 10 == 7:
            text += "\nAll Rights Reserved.\nLicensed under CC BY-NC 4.0."
        rows.append((k, text, lang, f"s{k % 4}", len(text)))
    odd = [None, "", " \n\t ", "x", "A b", "x " * 300, "same line\n" * 60, "é É ü", "w" * 5000 + " b c d", "12 34 | |", "rows\rand\x0btabs"]
    rows += [(n + k, text, None if k % 2 else "en", None, None) for k, text in enumerate(odd)]
    return rows + [rows[1], rows[1]]


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(corpus(), COLUMNS)
    for name in ("fp", "w", "h", "spans", "key", "label", "slot", "words"):
        extra = extra.withColumn(name, F.lit("clash"))
    return extra.repartition(4).cache()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in corpus()}


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


# --- SimHash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = words(ascii_lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_xxh64_spans_agrees_with_the_library():
    data = bytes(random.Random(0).randrange(256) for _ in range(3000))
    starts = np.arange(0, 300)
    lengths = np.concatenate([np.arange(200), np.arange(500, 600)])
    want = [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts, lengths, strict=True)]
    assert xxh64_spans(data, starts, lengths, 42).tolist() == want


def classes(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_simhash_against_brute_force(spark, docs, texts):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert all(r.fp % (1 << 64) == fps[r.doc_id] for r in got)
    ids = sorted(fps)
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("rows", [30, 700])
def test_bucket_links_connect_all_near_fingerprints(spark, rows):
    rng = random.Random(rows)
    values = set()
    for _ in range(rows // 10):
        base = rng.getrandbits(64)
        for _ in range(10):
            v = base
            for _ in range(rng.randrange(6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    # A small bucket bound makes tiles; few blocks make large buckets.
    links = simhash.bucket_links(spark.createDataFrame(signed, "fp long"), blocks=5, bucket_rows=16).collect()
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert classes(values, pairs) == classes(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])


def test_large_links_sweep_one_bucket():
    rng = random.Random(5)
    values = np.array(sorted({(k % 40) << 20 ^ 1 << rng.randrange(10) ^ 1 << rng.randrange(60) for k in range(900)}), dtype=np.uint64)
    links = simhash.large_links(values)
    plain = [int(v) for v in values]
    near = [(a, b) for a in plain for b in plain if a < b and (a ^ b).bit_count() <= 4]
    assert classes(plain, [(int(a), int(b)) for a, b in links]) == classes(plain, near)


def test_large_links_follow_chains_between_components():
    bits = lambda *at: sum(1 << b for b in at)
    chain = [0, bits(28, 37, 46, 55)]
    chain += [chain[-1] ^ bits(29, 38, 47, 56)]
    chain += [chain[-1] ^ bits(30, 39, 48, 57)]
    rng = random.Random(3)
    far = [rng.getrandbits(37) << 27 for _ in range(60)]
    values = [chain[0], chain[3], *far, chain[1], chain[2]]
    links = [(int(a), int(b)) for a, b in simhash.large_links(np.array(values, dtype=np.uint64))]
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    assert len(near) >= 3 and classes(values, links) == classes(values, near)
    # Many chains of random steps, their members in any order.
    values = set()
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 60)):
            values.add(v)
            v ^= bits(*rng.sample(range(64), 4))
    values = rng.sample(sorted(values), len(values))
    links = [(int(a), int(b)) for a, b in simhash.large_links(np.array(values, dtype=np.uint64))]
    assert all((a ^ b).bit_count() <= 4 for a, b in links) and len(links) < len(values)
    assert classes(values, links) == classes(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# --- suffix arrays -------------------------------------------------------------------------------------------------


def plain_repeats(rows, length):
    """(id, repeated word places) for each row (id, text), the first occurrence being that of the smallest id."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w, covered = words(text), set()
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                covered.update(range(i, i + length))
            seen.add(key)
        out.append((d, covered))
    return out


def listed(found):
    return sorted(((str(d), sorted(covered)) for d, covered in found), key=repr)


def spans_of(rows):
    return [(r.doc_id, {i for s in r.spans for i in range(s.first, s.until)}) for r in rows]


@pytest.mark.parametrize(("length", "gram", "run_rows"), [(50, 10, 2000), (8, 3, 2000), (8, 3, 1), (8, 3, 6)])
def test_suffix_dedup_against_brute_force(spark, docs, length, gram, run_rows):
    got = suffix_dedup.repeats(docs, length=length, gram=gram, run_rows=run_rows).collect()
    assert listed(spans_of(got)) == listed(plain_repeats([r[:2] for r in corpus()], length))
    assert all(r.n_removed == sum(s.until - s.first for s in r.spans) and bool(r.spans) == bool(r.first_docs) for r in got)
    assert suffix_dedup.repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("run_rows", [2000, 3])
def test_suffix_dedup_finds_windows_between_unlike_neighbours(spark, run_rows):
    rng = random.Random(9)
    middle = [f"m{k}" for k in range(14)]
    rows = []
    for k in range(120):
        left, right = [f"l{rng.randrange(4)}-{i}" for i in range(9)], [f"r{rng.randrange(4)}-{i}" for i in range(9)]
        fixed = [[f"l{rng.randrange(3)}x{i}" for i in range(9)], [f"r{rng.randrange(3)}x{i}" for i in range(9)]]
        cut_left, cut_right = rng.randrange(10), rng.randrange(10)
        left, right = left[:cut_left] + fixed[0][cut_left:], fixed[1][:cut_right] + right[cut_right:]
        rows.append((k if k % 7 else (1 << 60) + k, " ".join([f"a{k}", *left, *middle, *right, f"z{k}"])))
    rows += [(None, rows[0][1]), (None, rows[3][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for length, gram in ((20, 4), (16, 10), (24, 2)):
        got = suffix_dedup.repeats(docs, length=length, gram=gram, run_rows=run_rows).collect()
        assert listed(spans_of(got)) == listed(plain_repeats(rows, length))


def test_extension_against_all_pairs():
    rng = random.Random(8)
    for _ in range(60):
        n, length = rng.randrange(2, 12), 6
        sides = [([rng.choice("ab") for _ in range(rng.randrange(7))], [rng.choice("ab") for _ in range(2, 8)]) for _ in range(n)]
        rows = []
        for k, (left, right) in enumerate(sides):
            hi = len(left)
            lo = max(length - len(right), 0)
            if lo <= hi:
                rows.append((k % 2, "".join(w + " " for w in right), "".join(w + " " for w in left), lo, hi))
        rows.sort()
        if not rows:
            continue
        runs, right, left, lo, hi = (list(x) for x in zip(*rows, strict=True))
        rank = rng.sample(range(len(rows)), len(rows))
        i, a, j = suffix_dedup.extended(np.array(runs), [x.encode() for x in right], [x.encode() for x in left], np.array(lo), np.array(hi), np.array(rank), length)
        want = set()
        for x in range(len(rows)):
            for at in range(lo[x], hi[x] + 1):
                window = (runs[x], left[x].split()[:at], right[x].split()[: length - at])
                same = [y for y in range(len(rows)) if lo[y] <= at <= hi[y] and (runs[y], left[y].split()[:at], right[y].split()[: length - at]) == window]
                first = min(same, key=rank.__getitem__)
                if first != x:
                    want.add((x, at, first))
        assert set(zip(i.tolist(), a.tolist(), j.tolist(), strict=True)) == want


def test_cut_stage_keeps_the_rest_as_it_was(spark, docs):
    columns = [c.split()[0] for c in COLUMNS.split(", ")]
    kept = sorted((r.doc_id, r.text, r.n_chars) for r in suffix_dedup.cut_stage(spark, docs.select(columns), "").collect())
    texts, want = {r[0]: r for r in corpus()}, []
    for d, gone in plain_repeats([r[:2] for r in corpus()], 50):
        left = [w for i, w in enumerate(words(texts[d][1])) if i not in gone]
        if left or not gone:
            want.append((d, left, bool(gone)))
    assert [(d, words(t)) for d, t, _ in kept] == [(d, left) for d, left, _ in sorted(want)]
    changed = {d for d, _, cut in want if cut}
    assert all((t, n) == (texts[d][1], texts[d][4]) if d not in changed else n == len(t) for d, t, n in kept)


# --- rules, labels, scores -----------------------------------------------------------------------------------------


def plain_statistics(text):
    w, n = words(text), len(words(text))
    count = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeated = {i + k for i in range(n - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules_against_brute_force(spark, docs, texts):
    trusted = docs.where("doc_id % 10 != 6 and doc_id < 80")
    got = quality_rules.judge(docs, trusted, buckets=512, prior=100.0).collect()
    assert len(got) == len(corpus())
    for r in got:
        n, *rest = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    hashed = spark.createDataFrame([(a,) for a in sorted({w for t in texts.values() for w in words(t)})], "a string")
    bucket = {r.a: r.b for r in hashed.select("a", F.pmod(F.xxhash64("a"), F.lit(512)).alias("b")).collect()}
    raw = Counter(bucket[w] for d, t, *_ in corpus() for w in words(t))
    good = Counter(bucket[w] for d, t, *_ in corpus() if d % 10 != 6 and d < 80 for w in words(t))
    weights = {r.bucket: r.weight / 1e6 for r in quality_rules.weights(docs, trusted, 512, 100.0).collect() if r.bucket < 512}
    total, total_good = 2 * sum(raw.values()) - sum(1 for d, t, *_ in corpus() if words(t)), 2 * sum(good.values()) - sum(1 for d, t, *_ in corpus() if d % 10 != 6 and d < 80 and words(t))
    for b, n in raw.items():
        p = n / total
        assert weights[b] == pytest.approx(np.log((good[b] + 100 * p) / (total_good + 100) / p), abs=2e-6)
    assert quality_rules.judge(empty(spark), empty(spark)).count() == 0


def test_junk_fails_and_clean_texts_pass(docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs, docs.where("doc_id % 10 != 6 and doc_id < 80"), buckets=4096, prior=100.0).collect()}
    long = {d for d, r in got.items() if not r.base_failed and d < 80}
    assert {d for d in long if not got[d].kept} == {d for d in long if d % 10 == 6}


def test_trusted_texts_are_scored_without_their_own_counts(spark, docs):
    own = docs.where("doc_id % 10 != 6 and doc_id < 80").select("doc_id").distinct()
    got = quality_rules.judge(docs, docs.join(own, "doc_id", "left_semi"), 64, 20.0, threshold=None, own=own).collect()
    grams = [(d, [(a, None) for a in words(t)] + list(zip(words(t), words(t)[1:], strict=False))) for d, t, *_ in corpus()]
    hashed = spark.createDataFrame(sorted({g for _, every in grams for g in every}, key=repr), "a string, b string")
    u, v = quality_rules.bucket(F.col("a"), buckets=64), quality_rules.bucket(F.col("a"), F.col("b"), buckets=64)
    bucket = {(r.a, r.b): r.x for r in hashed.select("a", "b", F.when(F.col("b").isNull(), u).otherwise(v).alias("x")).collect()}
    counts = [(d, Counter(bucket[g] for g in every)) for d, every in grams]
    trusted = {r.doc_id for r in own.collect()}
    raw, good = sum((c for _, c in counts), Counter()), sum((c for d, c in counts if d in trusted), Counter())
    want = []
    for d, c in counts:
        left = Counter({b: good[b] - (c[b] if d in trusted else 0) for b in c})
        size, total = c.total(), good.total() - (c.total() if d in trusted else 0)
        share = {b: raw[b] / raw.total() for b in c}
        want.append((d, sum(n * np.log((left[b] + 20 * share[b]) / (total + 20) / share[b]) for b, n in c.items()) / size if size else 0.0))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    pairs = list(zip(sorted(((r.doc_id, r.llr) for r in got), key=key), sorted(want, key=key), strict=True))
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=2e-6) for a, b in pairs)
    # The threshold is the low quantile of the trusted rows past the base rules.
    past = [r for r in got if not r.base_failed]
    limit = np.quantile([r.llr for r in past if r.doc_id in trusted], quality_rules.LOST)
    assert all(r.kept == (r.llr >= limit - 1e-12) for r in past) and not any(r.kept for r in got if r.base_failed)
    none = docs.limit(0).select("doc_id")
    untold = quality_rules.judge(docs, docs.limit(0), 64, 20.0, threshold=None, own=none).collect()
    assert all(r.llr == 0 and r.kept != r.base_failed for r in untold)


def test_all_trusted_labels_are_learned_from(spark):
    labels = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality_rules.trusted_ids(labels.union(labels)).count() == 12_000
    values = spark.createDataFrame([(x,) for x in [3.5, -1.0, 2.0, 2.0, 2.0, 1e-12, 7.25, None]], "x double")
    for share in (0.0, 0.01, 0.3, 0.5, 0.77, 1.0):
        assert quality_rules.quantile(values, share) == pytest.approx(np.quantile([3.5, -1.0, 2.0, 2.0, 2.0, 1e-12, 7.25], share))
    assert quality_rules.quantile(values.limit(0), 0.5) is None


def test_pipeline_stage_finds_candidates_by_simhash(spark, monkeypatch):
    base = [" ".join(f"w{k * j % 7919}" for j in range(1, 2001)) for k in (3, 5)]
    texts = [*base, base[0] + " tail", base[0].upper(), "end " + base[1], "few words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash.shingled(docs).localCheckpoint()
    full = [(r.fp, r.sim, s) for r, s in zip(rows.collect(), simhash.shingle_sets([r.d.text for r in rows.collect()]), strict=True) if len(s)]
    for _, sim, own in full:
        bits = ((own[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0) * 2 > len(own)
        assert sim % (1 << 64) == sum(1 << k for k, bit in enumerate(bits.tolist()) if bit)
    sims = dict((fp, sim) for fp, sim, _ in full)
    near = [(a, b) for a in sims for b in sims if a < b and bin((sims[a] ^ sims[b]) % (1 << 64)).count("1") <= simhash.RADIUS]
    got = [tuple(r) for r in simhash.fingerprint_links(rows.select("fp", "sim").distinct()).collect()]
    assert near and classes(sims, got) == classes(sims, near)
    # Without bands the fingerprints alone bring near copies together.
    monkeypatch.setattr(simhash, "BANDS", 0)
    assert {r.doc_id for r in simhash.similar_rows(simhash.shingled(docs).localCheckpoint()).where("row != keeper").collect()} == {2, 3, 4, 7}


def test_license_scan_against_brute_force(spark, docs, texts):
    got = license.scan(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(texts[r.doc_id]))
        at = sorted((i, label) for phrase, label in license.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert license.scan(empty(spark)).count() == 0


def test_license_spans_survive_inserted_and_missing_words(spark):
    notice = "x y This WORK is licensed under the very GNU General Public License, version 3."
    rows = [(1, notice), (2, "licensed under the"), (3, "Released, under the MIT-license! released under the mit license"), (4, None)]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "gpl,gpl-notice" and got[1].first_word == 10 and 0.7 <= got[1].score <= 1
    assert got[2].labels == "" and got[4].n_words == 0
    assert got[3].labels == "mit" and len(got[3].spans) == 2


def test_rule_ensemble_learns_and_compiles(spark, docs):
    labels = spark.createDataFrame([(k, int(k % 10 != 6)) for k in range(80)], "doc_id long, quality int")
    model = rule_ensemble.fit(docs, labels)
    assert model.rules
    scored = {r.doc_id: r.s for r in rule_ensemble.with_statistics(docs).select("doc_id", model.score().alias("s")).collect()}
    right = [(scored[k] >= 0.5) == (k % 10 != 6) for k in range(80)]
    assert sum(right) >= 76 and all(0 <= s <= 1 for s in scored.values())
    one_kind = rule_ensemble.fit(docs, labels.where("quality = 1"))
    assert not one_kind.rules and one_kind.intercept > 0
    assert rule_ensemble.fit(empty(spark), labels.limit(0)).intercept == 0


def test_tree_rules_tighten_bounds():
    told = "Tree\n  If (feature 0 <= 2.0)\n   If (feature 0 <= 1.0)\n    Predict: 1.0\n   Else (feature 0 > 1.0)\n    Predict: 0.0\n  Else (feature 0 > 2.0)\n   Predict: 1.0\n"
    assert rule_ensemble.tree_rules(told, ("a",)) == {(("a", "<=", 2.0),), (("a", "<=", 1.0),), (("a", "<=", 2.0), ("a", ">", 1.0)), (("a", ">", 2.0),)}


def plain_viterbi(scores, switch):
    best = scores[0].copy()
    for row in scores[1:]:
        best = np.maximum(best, best.max() - switch) + row
    return best.max()


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    scores = [rng.normal(0, 6, (n, 4)) for n in (1, 2, 30, 7, 30, 200)]
    for own, path in zip(scores, langid.viterbi(scores, 8.0), strict=True):
        value = own[np.arange(len(path)), path].sum() - 8.0 * (np.diff(path) != 0).sum()
        assert value == pytest.approx(plain_viterbi(own, 8.0))


def test_language_id(spark, docs, texts):
    model = langid.fit(docs.where("doc_id % 4 != 2"))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(corpus())
    for r in got:
        has_letter = bool(texts[r.doc_id]) and any(c.isalpha() for c in texts[r.doc_id])
        assert (r.lang_pred == "und") == (not has_letter) and 0 <= r.score <= 1
    right = [r.lang_pred == ("en" if r.doc_id % 3 else "de") for r in got if r.doc_id < 80 and r.doc_id % 4 == 2 and r.doc_id % 10 not in (5, 6) and len(words(texts[r.doc_id])) > 10]
    assert right and sum(right) / len(right) > 0.9
    mixed = langid.label_batch(model, [" ".join(["the of and with"] * 8 + ["der die das nicht"] * 8)])[0]
    assert [s[2] for s in mixed[2]] == ["en", "de"] and abs(mixed[2][0][1] - 32) <= 1
    assert langid.identify(docs, langid.fit(empty(spark))).where("lang_pred != 'und'").count() == 0
    assert langid.keep_identified(spark, docs, "").where("doc_id in (80, 81, 82)").count() == 0


def test_script_narrows_candidates():
    rows = np.zeros((langid.SLOTS, 2), np.float32)
    model = langid.Model(("en", "ru"), rows, np.array([1 << langid.NAMES.index("latin"), 1 << langid.NAMES.index("cyrillic")], np.uint32))
    assert [x[0] for x in langid.label_batch(model, ["привет", "hello", "漢字"])] == ["ru", "en", "en"]


# --- mixing, tokens, media, urls -----------------------------------------------------------------------------------


def test_raking_meets_its_targets(spark, docs):
    told = mixing.described(docs, mixing.topic_terms(docs, common=0.5))
    mixed = mixing.mix(told, rounds=8).select("doc_id", "words", *mixing.DIMENSIONS, "weight", "probability", "sampled", "draw").toPandas()
    assert len(mixed) == len(corpus())
    total = mixed.words.sum()
    for name, power in mixing.POWERS.items():
        sums = mixed.groupby(name).words.sum() ** power
        got = (mixed.words * mixed.weight).groupby(mixed[name]).sum()
        assert np.allclose(got, sums / sums.sum() * total, rtol=0.05)
    assert (mixed.words * mixed.probability).sum() == pytest.approx(mixing.BUDGET * total, rel=1e-6)
    assert (mixed.sampled == (mixed.draw < mixed.probability)).all() and mixed.probability.max() <= 1
    assert mixing.mix(mixing.described(empty(spark), [])).count() == 0 and mixing.topic_terms(empty(spark)) == []


def test_topics_against_counting(docs):
    rows = corpus()
    terms = mixing.topic_terms(docs, terms=5, letters=6, common=0.4)
    texts = [r[1] or "" for r in rows]
    dfs = Counter(w for t in texts for w in set(t.split(" ")) if re.fullmatch(r"[^\W\d_]{6,}", w))
    want = sorted(((w, n) for w, n in dfs.items() if n <= 0.4 * len(rows)), key=lambda x: (-x[1], x[0]))[:5]
    assert terms == [(w, pytest.approx(np.log(len(rows) / n))) for w, n in want]
    got = sorted((r.doc_id, r.topic) for r in mixing.described(docs, terms).collect())
    plain = []
    for r, low in zip(rows, texts, strict=True):
        best = max(range(5), key=lambda k: (low.count(terms[k][0]) * terms[k][1], -k))
        plain.append((r[0], terms[best][0] if low.count(terms[best][0]) else "other"))
    assert got == sorted(plain)


def test_raking_keeps_values_without_a_target(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("a", "y", "t", 30), ("b", "x", "t", 20), ("c", "y", "t", 0)], "source string, lang string, topic string, words long")
    targets = {"source": spark.createDataFrame([("a", 80.0), ("none", 5.0)], "value string, target double"), "lang": spark.createDataFrame([("x", 50.0), ("y", 50.0)], "value string, target double")}
    fitted = mixing.rake(cells, targets, rounds=1)
    got = {(r.source, r.lang): r.fitted for r in fitted.collect()}
    assert got[("a", "x")] == pytest.approx(25) and got[("b", "x")] == pytest.approx(25) and got[("a", "y")] == pytest.approx(50) and got[("c", "y")] == 0
    assert mixing.marginal_error(fitted, {"lang": targets["lang"]}) == pytest.approx(0) and mixing.marginal_error(fitted, targets) == pytest.approx(5 / 80)


@pytest.mark.parametrize("most", [mixing.TASK_CELLS, 2])
def test_raking_ends_within_its_tolerance_or_where_targets_contradict(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "TASK_CELLS", most)
    monkeypatch.setattr(mixing, "BLOCK", 2)
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 20), ("b", "y", 5)], "source string, lang string, words long")
    goals = lambda rows: spark.createDataFrame(rows, "value string, target double")
    targets = {"source": goals([("a", 20.0), ("b", 45.0)]), "lang": goals([("x", 40.0), ("y", 25.0)])}
    fitted = mixing.rake(cells, targets, tolerance=1e-6)
    assert mixing.marginal_error(fitted, targets) <= 1e-6
    plain = np.array([[10.0, 30.0], [20.0, 5.0]])
    for _ in range(100):
        plain *= (np.array([20.0, 45.0]) / plain.sum(1))[:, None]
        plain *= np.array([40.0, 25.0]) / plain.sum(0)
    got = {(r.source, r.lang): r.fitted for r in fitted.collect()}
    assert [got[k] for k in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"))] == pytest.approx(plain.ravel().tolist(), rel=1e-5)
    apart = spark.createDataFrame([("a", "x", 10), ("b", "y", 30)], "source string, lang string, words long")
    against = {"source": goals([("a", 30.0), ("b", 10.0)]), "lang": goals([("x", 10.0), ("y", 30.0)])}
    assert sorted((r.source, r.fitted) for r in mixing.rake(apart, against).collect()) == [("a", pytest.approx(10)), ("b", pytest.approx(30))]


def test_probabilities_meet_any_budget(spark):
    rows = [(f"s{k}", "l", "t", w, float(f)) for k, (w, f) in enumerate([(10, 90), (40, 60), (100, 60), (50, 20), (0, 0), (7, 7)])]
    fitted = spark.createDataFrame(rows, "source string, lang string, topic string, words long, fitted double")
    for budget in (0.05, 0.3, 0.8, 0.97, 1.0):
        got = mixing.probabilities(fitted, budget).collect()
        assert sum(r.words * r.probability for r in got) == pytest.approx(budget * 207)
        free = [r.probability / r.weight for r in got if r.words and r.probability < 1 - 1e-9]
        assert all(x == pytest.approx(free[0]) for x in free)


def test_bpe_equals_the_library(spark, docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.public_vocabulary())
    got = bpe.tokenize(docs, bpe.public_vocabulary(), outputs=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(got) == len(corpus())
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (texts[r.doc_id] or "")
    assert bpe.tokenize(empty(spark), bpe.public_vocabulary()).count() == 0


def test_bpe_on_hard_texts():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.public_vocabulary()), bpe.Bpe(bpe.public_vocabulary())
    encode = own.encoder()
    rng = random.Random(2)
    hard = ["<|endoftext|>", "a<|endoftext|> b", "  a\n\n b ", "I'll 'S can't", "日本 テスト", "a\x00b", "aaaa" * 99, "½ 12²", "👩‍👩‍👧 é"]
    hard += ["".join(chr(rng.choice([32, 10, 39, 97, 98, 233, 0x4E2D, 0x1F600, 49])) for _ in range(60)) for _ in range(50)]
    for text in hard:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_media_round_trip(spark, docs, texts, tmp_path):
    store = str(tmp_path / "store")
    media.store_payloads(docs, store)
    described = media.describe_store(spark.read.parquet(store))
    elements = media.sequences(media.pages_of(docs), "doc_id")
    got = media.resolve(elements, described, "doc_id").collect()
    assert len(got) == len(corpus())
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.to_png(payload)).hexdigest()
    lines = {r.doc_id: [e.text for e in r.elements if e.kind == "text"] for r in elements.collect()}
    assert all(lines[d] == [x for x in (t or "").split("\n") if x.strip()] for d, t in texts.items())


def test_sequences_keep_order_and_captions():
    page = "<p>a &amp; b</p><figure><img src='sha256:11'><img src=x.png alt=z><figcaption>two <b>pics</b></figcaption></figure>c<script>no</script><video src=v></video><p>d"
    got = [(e["pos"], e["kind"], e["text"] or e["digest"], e["caption"]) for e in media.parse_sequence(page)]
    assert got == [(0, "text", "a & b", None), (1, "media", "11", "two pics"), (2, "media", "x.png", "two pics"), (3, "text", "c", None), (4, "media", "v", None), (5, "text", "d", None)]
    assert media.parse_sequence(None) == [] == media.parse_sequence("<p><br>")
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"\0" * 576)[:-20] + b"\0" * 20)


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return ascii_lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules(spark):
    rng = random.Random(4)
    urls = [f"{s}://{h}/{p}/{k}{q}" for k in range(400) for s, h, p, q in [(rng.choice(["http", "HTTPS"]), rng.choice(["a.example.org", "B.example.com", "spam.example.net", "example.org", "xexample.org"]), rng.choice(["en", "es", "de", "fr"]), rng.choice(["", "?a=1", "#t"]))]]
    urls += [None, "", "no scheme", "x://", "http://h?x/y", "a://b://c/d", "http://EXAMPLE.org/en/12", "http://é.org/\n?"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("tokens", F.lit(1))
    labelled = url_rules.tokens_of(pages, "page_id", "url").withColumn("bad", F.array_contains("tokens", "host=spam") & F.array_contains("tokens", "path=es"))
    mined = url_rules.mine(labelled, min_hits=5)
    best = next(r for r in mined if r.verdict == "block")
    assert any("es" in t for t in best.tokens) and best.confidence == 1.0 and len(best.tokens) == 2
    rules = [url_rules.UrlRule(("host=spam", "path=es"), 0.1, 1.0)]
    got = {r.page_id: r for r in url_rules.judge(pages, rules).collect()}
    for k, url in enumerate(urls):
        host, path = plain_url(url)
        fits = [r for r in url_rules.FIXED_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        mined_hit = url is not None and "spam." in url and "/es/" in url
        assert (got[k].host, got[k].path) == (host, path)
        assert got[k].rule == (best[1] + best[2] if best else None)
        assert got[k].verdict == (best[0] if best else "block" if mined_hit else "allow")
    assert url_rules.mine(labelled.limit(0)) == []


def test_mining_against_counting(spark):
    rng = random.Random(12)
    rows = []
    for k in range(3000):
        tokens = sorted({"always", "twin1" if k % 3 else "lone", "twin2" if k % 3 else "lone2", *(rng.choice(x) for x in (["a1", "a2"], ["b1", "b2", "b3"], ["c1", "c2", "c3", "c4"], [f"rare{k}", "d"]))})
        bad = rng.random() < (0.9 if {"a1", "b2"} <= set(tokens) else 0.02 if "c4" in tokens else 0.15)
        rows.append((tokens, bad))
    data = spark.createDataFrame([*rows, ([], True), (["a1"], None)], "tokens array<string>, bad boolean")
    got = url_rules.mine(data, min_support=0.01)
    n, n_bad = len(rows), sum(bad for _, bad in rows)
    kinds = {}
    for token in {t for tokens, _ in rows for t in tokens}:
        where = frozenset(k for k, (tokens, _) in enumerate(rows) if token in tokens)
        if 30 <= len(where) < n:
            kinds[where] = min(token, kinds.get(where, token))
    held, counts = set(kinds.values()), Counter()
    for tokens, bad in rows:
        own = sorted(set(tokens) & held)
        for size in (1, 2, 3):
            for part in combinations(own, size):
                counts[part, None] += 1
                counts[part, "block" if bad else "allow"] += 1
    tried = [(part, v) for (part, v), m in counts.items() if v and m >= 30]
    z = NormalDist().inv_cdf(1 - 0.05 / len(tried))
    strong = {}
    for part, v in tried:
        base, confidence = n_bad / n if v == "block" else 1 - n_bad / n, counts[part, v] / counts[part, None]
        sigmas = (confidence - base) / (base * (1 - base) / counts[part, None]) ** 0.5
        if confidence >= url_rules.MIN_CONFIDENCE and sigmas >= z:
            strong[part, v] = (confidence, sigmas)
    for part, v in list(strong):
        if any(strong.get((p, v), (-1,))[0] >= strong[part, v][0] for size in range(1, len(part)) for p in combinations(part, size)):
            strong[part, v] = (*strong[part, v], "implied")
    want = {key: x for key, x in strong.items() if len(x) == 2}
    assert {(r.tokens, r.verdict): (pytest.approx(r.confidence), pytest.approx(r.sigmas)) for r in got} == want
    assert {v for _, v in want} == {"allow", "block"} and got == sorted(got, key=lambda r: -r.sigmas)


def test_no_rule_where_labels_ignore_urls(spark):
    rng = random.Random(3)
    rows = [([f"{c}{rng.randrange(4)}" for c in "abcd"], rng.random() < 0.15) for _ in range(3000)]
    assert url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")) == []


def test_index_takes_the_first_rule():
    rule = url_rules.UrlRule
    index = url_rules.RuleIndex([rule(("a", "c"), 0.05, 0.9), rule(("a",), 0.1, 0.8)])
    assert index.match(["a", "c"]) == 0 and index.match(["a", "b"]) == 1 and index.match(["c"]) == -1


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "quite another text of words"), (None, "quite another text of words"), (3, None), (3, None), (4, "one two three four five"), (4, "six seven eight nine ten")]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], COLUMNS)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_first(spark, docs, "").collect()), key=str)
    assert kept == sorted((rows[k] for k in (0, 3, 5, 7, 8)), key=str)
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs.where("doc_id != 4 or doc_id is null")).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (None, None), (3, 3)}


@pytest.mark.parametrize("tile_rows", [8, 256])
def test_near_copies_against_brute_force(spark, tile_rows):
    rng = random.Random(11)
    rows = corpus()
    vocabulary = [f"w{k}" for k in range(3000)]
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 60, 300, 900]))
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((1000 + len(rows), " ".join(text), "en", "s", 0))
    texts = {r[0]: r[1] for r in rows}
    sets = {}
    for d, text in texts.items():
        w = words(ascii_lower(text))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert sum((fps[a] ^ fps[b]).bit_count() > 4 for a, b in near) > 20
    docs = spark.createDataFrame(rows, COLUMNS)
    got = {r.doc_id: r.component_id for r in simhash.jaccard_duplicates(docs, tile_rows).collect()}
    assert got == classes(sorted(sets), near)
    kept = {r.doc_id for r in simhash.keep_first(spark, docs, "").collect()}
    assert kept == set(got.values())


def test_rows_of_one_id_lose_only_what_they_hold(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in ((1, passage), (2, passage + " more"), (2, "short"))], COLUMNS)
    kept = sorted((r.doc_id, r.text) for r in suffix_dedup.cut_stage(spark, docs, "").collect())
    assert kept == [(1, passage), (2, "more"), (2, "short")]


def test_numerals_are_no_letters():
    model = langid.Model(("en",), np.zeros((langid.SLOTS, 1), np.float32), np.array([1], np.uint32))
    assert [x[0] for x in langid.label_batch(model, ["½ ² ① 12", "ªx", "_"])] == ["und", "en", "und"]
