"""The bootstrap's draws against hashlib and plain Python, and their spread over tasks."""

from __future__ import annotations

import hashlib
import math

import numpy as np

from quillon.functions.digests import md5_heads
from quillon.operators import evaluation


def test_heads_equal_hashlib_over_and_beyond_one_block():
    prefixes = [b"", b"7", b"123456789", b"x" * 50, "ß€".encode(), b"y" * 54, b"z" * 90]
    suffixes = [b":%d" % k for k in (1, 9, 10, 999, 1000)]
    got = {}
    for starts, ends, heads in md5_heads(prefixes, suffixes):
        for i, a in enumerate(starts.tolist()):
            for j, b in enumerate(ends.tolist()):
                got[a, b] = int(heads[i, j])
    assert got == {(a, b): int(hashlib.md5(p + s).hexdigest()[:8], 16) for a, p in enumerate(prefixes) for b, s in enumerate(suffixes)}


def expected(rows, rounds):
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    out = {}
    for key in {k for k, _, _ in rows if k is not None}:
        own = [(v, n) for k, v, n in rows if k == key and v is not None]
        means = []
        for r in range(1, rounds + 1):
            drawn = [(sum(int(hashlib.md5(":".join([*([n] if n is not None else []), str(r)]).encode()).hexdigest()[:8], 16) / 2**32 >= e for e in edges), v) for v, n in own]
            if sum(w for w, _ in drawn):
                means.append(sum(w * v for w, v in drawn) / sum(w for w, _ in drawn))
        out[key] = (len(own), *np.percentile(means, [2.5, 97.5]))
    return out


def test_bootstrap_equals_plain_python_and_deals_one_partition_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "HELD_KEYS", 2)
    rows = [("abc"[i % 3], float(i * i % 17), str(i) if i % 7 else None) for i in range(60)] + [("c", None, "x"), (None, 1.0, "y")]
    df = spark.createDataFrame(rows, "k string, v double, n string").coalesce(1)
    found = evaluation.bootstrap(df, "k", "v", "n", rounds=120)
    want = expected(rows, 120)
    got = {r.k: (r.n, r.low, r.high) for r in found.collect()}
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9)
    # The dear step doesn't stay in the one task that reads the rows.
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().toString()
