"""Upper case by single characters, as DuckDB has it."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from quillon.functions import text as tx


def test_upper_equals_duckdb_for_every_character_that_java_expands(spark):
    texts = ["ßÜ Straße", "ŉ ǰ ﬁn", "plain é ñ", "", *(f"a{c}b" for c in tx._MANY)]
    got = [r.u for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select(tx.upper(F.col("t")).alias("u")).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT upper(?)", [t]).fetchall()[0][0] for t in texts]
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    assert spark.range(1).select(tx.upper(F.lit(None).cast("string")).alias("u")).first().u is None
