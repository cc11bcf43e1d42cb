"""N-gram join, importance resampling and conversation repair beside plain Python; scopes of written tables in threads."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import threading
import zlib

import pytest
from compare import SMALL
from pyspark.sql import functions as F

from quillon.llm import common, ngram_join, resample, turn_repair

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ("h", "k", "d", "row", "name", "n", "c", "key", "salt", "text_key", "at", "score", "rank", "none", "conv", "seg", "fault", "kind")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), pair by pair through an inverted index."""
    sets, parent, index = [shingles(x) for _, x in rows], list(range(len(rows))), {}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, own in enumerate(sets):
        shared = {}
        for g in own:
            for j in index.get(g, ()):
                shared[j] = shared.get(j, 0) + 1
            index.setdefault(g, []).append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                parent[root(j)] = root(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(s), low.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def families(n):
    """Edited copies of texts of many lengths, a passage that many share, and odd rows."""
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(k)] for k in (4, 5, 6, 9, 30, 120, 400, 1000)]
    rows = []
    for k in range(n):
        w = list(base[rng.randrange(8)])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        rows.append((k if k % 50 else None, " ".join(w + base[6][:50] if rng.random() < 0.1 else w)))
    return [*rows, (9001, None), (9001, None), (9002, ""), (9003, " \n"), (9004, "ONE"), (9005, "one"), (9006, "ONE"), (9007, "É"), (9008, "é"), ((1 << 60) + 1, "wide one")]


@pytest.mark.parametrize("share", [256, 10**9])
def test_join_equals_all_pairs(spark, monkeypatch, share):
    """With the second share all columns are dealt in parts; tiles are small in both."""
    monkeypatch.setattr(ngram_join, "HOT_SHARE", share)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 50)
    rows = families(700)
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in CLASHES))
    found = ngram_join.near_duplicates(df.repartition(5)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == linked(rows)


def test_join_of_chains_and_edges_of_the_bound(spark):
    """Chains whose ends don't link, and pairs at just 0.8 and just below."""
    word = [f"v{k}" for k in range(3000)]
    rows = [(k, " ".join(word[3 * k : 3 * k + 60])) for k in range(60)]
    rows += [(100, " ".join(word[2000:2008])), (101, " ".join([*word[2000:2008], "more"])), (102, " ".join(word[2100:2107])), (103, " ".join([*word[2100:2107], "more"]))]
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {d: c for d, _, c in linked(rows)} and found[59] == 0 and found[101] == 100 and found[103] == 103


def test_join_of_nothing(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame([(None, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(None, 0, None), (2, 0, 2)]


def test_overlaps_over_blocks_of_columns(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMN_BLOCK", 7)
    rng = random.Random(1)
    row = ngram_join.np.array(sorted(rng.sample(range(400), 60)), "u8")
    partners = [ngram_join.np.array(sorted({*rng.sample(row.tolist(), rng.randint(40, 60)), *rng.sample(range(400), rng.randint(0, 9))}), "u8") for _ in range(80)]
    want = [100 * len({*row.tolist()} & {*p.tolist()}) >= 80 * len({*row.tolist()} | {*p.tolist()}) for p in partners]
    assert ngram_join.overlaps(row, partners).tolist() == want and any(want) and not all(want)


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode("utf-8", "surrogatepass")) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target):
    """The contract's rows, by counting in Python."""
    own = [(d, *grams(x)) for d, x in docs]
    s, t = [0] * 10_000, [0] * 10_000
    for counts, each in ((s, [f for _, _, f in own]), (t, [grams(x)[1] for x in target])):
        for f in each:
            for b in f:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10_000.0) / ((a + 1.0) * (sum(t) + 10_000.0)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for d, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_resampling_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = resample.op12_importance_resampling(spark, SMALL).collect()
    assert sorted((tuple(r) for r in found), key=repr) == resampled(docs, target)


def test_resampling_of_odd_texts(spark):
    rng = random.Random(2)
    odd = [None, "", "...", "Ünï 日本語 a-b A1", "x" * 1000, "y" * 64 + " " + "z" * 65, "one", "\x7fa\x00b", " ".join(f"w{k % 997}" for k in range(60_000))]
    docs = [(k if k % 9 else None, x) for k, x in enumerate([*odd, *(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(300))])] + [(5, "same a b"), (5, "same a b")]
    target = ["a a b", None, "日本語"]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = resample.scored(df, resample.fit(df, spark.createDataFrame([(x,) for x in target], "text string")))
    with common.scratch(spark) as outlive:
        found = outlive(resample.ranked(rows.select("d.doc_id", "n_words", "n_features", "weight", "score"))).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found), key=repr) == resampled(docs, target)
    wide = df.select("*", *(F.lit(1).alias(c) for c in CLASHES))
    drawn = resample.draw(wide, spark.createDataFrame([(x,) for x in target], "text string"))
    assert drawn.columns == wide.columns and sorted((r.doc_id for r in drawn.collect()), key=repr) == sorted((r[0] for r in resampled(docs, target) if r[4]), key=repr)


def test_resampling_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.draw(empty, empty).collect() == []
    one = spark.createDataFrame([(1, " ".join("abcdefghij" * 4))], "doc_id long, text string")
    assert [r.doc_id for r in resample.draw(one, empty, percent=100).collect()] == [1]


def repaired(rows):
    """The contract's row of each conversation, by the cheapest path over (row, state) with its audit."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        mark = hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest()
        convs[c] += [(t is not None, t or 0, r, mark, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    follows, name = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda z: z[:4])
        seen, faults = set(), []
        for _, _, r, _, x in own:
            last = x.strip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("b" if not last else "d" if (r, x) in seen else "t" if last not in ".!?" else "")
            seen.add((r, x))
        turns, firsts = [t for numbered, t, *_ in own if numbered], [r[:1] for _, _, r, _, _ in own]
        queue, done = [(0, "", 0, "", "")], set()
        while True:
            cost, audit, i, state, text = heapq.heappop(queue)
            if (i, state) in done:
                continue
            if i == len(own) and state in ("", "a"):
                break
            done.add((i, state))
            nxt = follows[state]
            ways = [(5, "I", i, nxt, f"{name[nxt]}:\n")]
            if i < len(own):
                r, x = own[i][2], own[i][4]
                ways.append((2, "D", i + 1, state, ""))
                if faults[i] not in ("b", "d"):
                    more = 5 * (faults[i] == "t")
                    ways.append((1 + more, "R", i + 1, nxt, f"{name[nxt]}:{x}\n"))
                    if r[:1] == nxt or (r[:1] == "s" and not state):
                        ways.append((more, "K", i + 1, r[:1], f"{r}:{x}\n"))
            for k, a, j, to, line in ways:
                heapq.heappush(queue, (cost + k, audit + a, j, to, text + line))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        out[c] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, text[:-1])
    return out


def odd_conversations():
    rng = random.Random(3)
    for c in [*range(40), None]:
        for t in range(rng.choice([0, 1, 2, 5, 9, 40]) if c else 900):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, "", "silent"])
            yield c, rng.choice([t, t, None, t + rng.randint(0, 3)]), role, rng.choice(["Yes.", "no", " ", None, "Ok!", f"t {t}.", f"t {t}.", f"t {t}?", "x\x0b"])


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("sizes", [(256, 64), (4, 2)])
def test_repair_equals_cheapest_paths(spark, monkeypatch, sizes):
    """With the second sizes long conversations compose over many levels."""
    monkeypatch.setattr(turn_repair, "SEGMENT", sizes[0])
    monkeypatch.setattr(turn_repair, "FAN", sizes[1])
    rows = list(odd_conversations())
    if sizes[0] == 4:
        rows = [r for r in rows if r[0]] + [(500, k, "user" if k % 3 else "assistant", f"line {k}.") for k in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit(1).alias(c) for c in CLASHES))
    want = repaired(rows)
    damaged = turn_repair.damage(df)
    assert {r.conv_id: tuple(r)[1:] for r in turn_repair.report(df, damaged).collect()} == {c: (*w[:-1], digest(w[-1])) for c, w in want.items()}
    if sizes[0] == 256:
        lines = {}
        for r in turn_repair.repair(damaged).orderBy("conv_id", "place").collect():
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert lines == {None if c is None else str(c): w[-1].split("\n") for c, w in want.items() if w[-1]}


def test_repair_query_equals_cheapest_paths(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in turn_repair.op13_conversation_repair(spark, SMALL).collect()}
    assert found == {c: (*w[:-1], digest(w[-1])) for c, w in repaired(rows).items()}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.report(empty, turn_repair.damage(empty)).collect() == []
    one = spark.createDataFrame([(1, 1, "user", "a.")], empty.schema)
    assert [tuple(r) for r in turn_repair.report(one, turn_repair.damage(empty)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", digest(""))]


def test_one_threads_scope_leaves_the_others_tables(spark):
    begun, ended, kept = threading.Event(), threading.Event(), []

    def other():
        with common.scratch(spark):
            df = common.written(spark.range(10).toDF("x"))[0]
            begun.set()
            assert ended.wait(60)
            kept.append(df.count())

    thread = threading.Thread(target=other)
    thread.start()
    assert begun.wait(60)
    with common.scratch(spark):
        common.written(spark.range(5).toDF("x"))
    ended.set()
    thread.join()
    assert kept == [10]
