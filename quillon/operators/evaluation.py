"""Ranking metrics, binned analyses and significance tests."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quillon.functions.digests import md5_heads

KS = (1, 3, 5, 10)
#: Keys whose sums a task of the bootstrap holds at once.
HELD_KEYS = 512


def single_target(ranked: DataFrame, targets: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """One row a target (query_id, doc_id): hit, NDCG and reciprocal rank at each k; a target that wasn't retrieved has 0."""
    joined = targets.join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    cols = [F.col("query_id"), F.col("doc_id"), F.col("rank")]
    for k in ks:
        hit = F.coalesce(F.col("rank") <= k, F.lit(False))
        cols += [
            hit.cast("double").alias(f"h_at{k}"),
            F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0).alias(f"n_at{k}"),
            F.when(hit, 1 / F.col("rank")).otherwise(0.0).alias(f"mrr_at{k}"),
        ]
    return joined.select(*cols)


def relevant_sets(ranked: DataFrame, relevant: DataFrame, k: int = 10, sizes: DataFrame | None = None) -> DataFrame:
    """One row a query of ranked (query_id, doc_id, rank) against relevant (query_id, doc_id): precision, recall, average precision,
    NDCG, reciprocal rank, F1, cumulative gain, ERR, RBP, R-precision, bpref and mean rank at k.

    sizes: (query_id, r), the distinct relevant documents of each query, where they are known; of relevant, then, only the pairs in
    ranked are read.
    """
    marked = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "doc_id", F.lit(1).alias("rel")), ["query_id", "doc_id"], "left")
    marked = marked.withColumn("rel", F.coalesce("rel", F.lit(0)))
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("hits_before", F.coalesce(F.sum("rel").over(before), F.lit(0)))
    marked = marked.withColumn("misses_before", F.coalesce(F.sum(1 - F.col("rel")).over(before), F.lit(0)))
    if sizes is None:
        sizes = relevant.groupBy("query_id").agg(F.countDistinct("doc_id").alias("r"))
    joined = marked.join(sizes, "query_id")
    rel, rank, r = F.col("rel"), F.col("rank"), F.col("r")
    sums = joined.groupBy("query_id", "r").agg(
        F.sum(rel).alias("hits"),
        F.sum(rel / F.log2(rank + 1)).alias("dcg"),
        F.sum(rel * (F.col("hits_before") + 1) / rank).alias("ap"),
        F.min(F.when(rel == 1, rank)).alias("first"),
        F.sum(F.lit(0.5) * F.pow(F.lit(0.5), rank - 1) * rel).alias("rbp"),
        F.sum(F.when(rank <= r, rel).otherwise(0)).alias("r_hits"),
        F.sum(rel * (1 - F.col("misses_before") / r)).alias("bp"),
        F.avg(F.when(rel == 1, rank)).alias("mean_rank"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(r, F.lit(k))), F.lit(0.0), lambda t, i: t + 1 / F.log2(i.cast("double") + 1))
    p, c = F.col("hits") / k, F.col("hits") / r
    return sums.select(
        "query_id",
        p.alias("precision"),
        c.alias("recall"),
        (F.col("ap") / F.least(r, F.lit(k))).alias("ap"),
        (F.col("dcg") / ideal).alias("ndcg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide(2 * p * c, p + c), F.lit(0.0)).alias("f1"),
        F.col("hits").cast("double").alias("cg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("err"),
        "rbp",
        (F.col("r_hits") / r).alias("r_precision"),
        (F.col("bp") / r).alias("bpref"),
        F.coalesce("mean_rank", F.lit(k + 1.0)).alias("avg_rank"),
    )


def novelty(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, novelty): over the first k places, each relevant document counts 1 / (1 + times it stood before), divided by k.
    ranked (query_id, doc_id, rank) may repeat documents; a query without a relevant one has 0."""
    again = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    marked = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1.0)), ["query_id", "doc_id"], "left")
    return marked.withColumn("again", again).groupBy("query_id").agg((F.coalesce(F.sum(F.col("rel") / F.col("again")), F.lit(0.0)) / k).alias("novelty"))


def random_window(targets: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, p, n): expected hit and NDCG of k documents in doc_id order from a uniformly drawn start.

    This is the value that repeated draws tend to.  Only a target among the first k - 1 documents has fewer than k starts
    that reach it, so k - 1 ids are all that is looked up; targets that docs lacks have 0.  doc_id is unique in docs.
    """
    total = float(docs.count()) or 1.0
    first = docs.select("doc_id").orderBy("doc_id").limit(k - 1).withColumn("starts", F.row_number().over(Window.orderBy("doc_id")))
    held = targets.join(docs.select("doc_id", F.lit(True).alias("held")), "doc_id", "left").join(F.broadcast(first), "doc_id", "left")
    starts = F.when(F.col("held"), F.coalesce("starts", F.lit(k))).otherwise(0)
    gains = F.element_at(F.array(*(F.lit(sum(1 / math.log2(r + 1) for r in range(1, n + 1))) for n in range(k + 1))), starts + 1)
    return held.select("query_id", "doc_id", (starts / total).alias("p"), (gains / total).alias("n"))


def domain_levels(records: DataFrame, domain: str, depth: str, hit: str) -> DataFrame:
    """(domain, low, mid, high, score): mean hit at depths up to 2, 3 to 4 and from 5, the mean size of the two steps between
    them, and a row all domains (domain null) of plain means over the domains that have a value."""
    d = F.col(depth)
    levels = {"low": d <= 2, "mid": d.between(3, 4), "high": d >= 5}
    each = records.groupBy(F.col(domain).alias("domain")).agg(*(F.avg(F.when(holds, F.col(hit))).alias(c) for c, holds in levels.items()))
    each = each.withColumn("score", (F.abs(F.col("mid") - F.col("low")) + F.abs(F.col("high") - F.col("mid"))) / 2)
    # One row a domain is left, so the grouping sets read few rows.
    return each.rollup("domain").agg(*(F.avg(c).alias(c) for c in ("low", "mid", "high", "score")))


def bin_of(value: Column, bounds: Sequence[tuple[float, float]], labels: Sequence[str]) -> Column:
    """The label of the left-closed bin that holds value; null outside all of them."""
    out = F.lit(None).cast("string")
    for (low, high), label in zip(bounds, labels, strict=True):
        out = F.when((value >= low) & (value < high), label).otherwise(out)
    return out


def noise_robustness(clean: Column, noisy: Column) -> Column:
    """max(0, 1 - |change| / clean); for clean = 0, 1 if noisy is 0 too, else 0."""
    return F.when(clean == 0, F.when(noisy == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(noisy - clean) / clean))


def bootstrap(values: DataFrame, key: str, value: str, row: str, rounds: int = 1000, level: float = 0.95) -> DataFrame:
    """(key, n, mean, low, high): percentile intervals of the mean; row names a column that tells rows apart.

    Each round draws a Poisson(1) weight for each row by an MD5 of row and round, so that equal values are drawn
    independently and results repeat.  Rows are dealt evenly, since each costs rounds digests however few bytes it has; a
    task sums its rows' weights by key and round and passes on those sums alone.  A round that draws no row of a key is
    left out; rows without a value are not drawn.
    """
    spark = values.sparkSession
    rows = values.select(key, F.col(value).cast("double").alias("v"), F.col(row).cast("string").alias("row")).where("v is not null")
    schema = StructType([rows.schema[key], *(StructField(name, DoubleType()) for name in ("w", "wv")), StructField("round", IntegerType())])
    drawn = rows.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_drawn_sums(key, rounds, to_arrow_schema(schema)), schema)
    sums = drawn.groupBy(key, "round").agg(F.sum("w").alias("w"), (F.sum("wv") / F.sum("w")).alias("m")).where("w > 0")
    # rounds numbers for each key
    edges = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    ends = sums.groupBy(key).agg(edges.alias("e")).select(key, F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("mean")).join(ends, key)


def _drawn_sums(key: str, rounds: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches (key, v, row) to (key, w, wv, round): sums of the weights and of the weighted values of rows, by key and round."""
    edges = np.cumsum([math.exp(-1) / math.factorial(count) for count in range(8)])
    bounds = [np.uint32(math.ceil(edge * 2**32)) for edge in edges]
    numbers = [str(k).encode() for k in range(1, rounds + 1)]
    joined = [b":" + k for k in numbers]

    def told(held: dict) -> pa.RecordBatch:
        sums = np.stack(list(held.values()))
        keys = pa.array(list(held), schema.field(key).type).take(pa.array(np.repeat(np.arange(len(held)), rounds)))
        return pa.RecordBatch.from_arrays([keys, pa.array(sums[:, 0].ravel()), pa.array(sums[:, 1].ravel()), pa.array(np.tile(np.arange(1, rounds + 1, dtype=np.int32), len(held)))], schema=schema)

    def add(held: dict, keys: list, v: np.ndarray, rows: list[bytes], suffixes: list[bytes]) -> None:
        for at, ends, heads in md5_heads(rows, suffixes):
            w = np.zeros(heads.shape, np.float64)
            for bound in bounds:
                w += heads >= bound
            with np.errstate(invalid="ignore"):
                wv = np.where(w > 0, w * v[at, None], 0.0)
            own = [keys[i] for i in at.tolist()]
            starts = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
            for i, a, b in zip(starts, np.add.reduceat(w, starts), np.add.reduceat(wv, starts), strict=True):
                held[own[i]][0, ends] += a
                held[own[i]][1, ends] += b

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            order, names = np.argsort(codes.indices.to_numpy(), kind="stable"), codes.dictionary.to_pylist()
            for low in range(0, len(order), HELD_KEYS):
                part = pa.array(order[low : low + HELD_KEYS])
                keys = [names[i] for i in codes.indices.take(part).to_pylist()]
                v, rows = batch.column(1).take(part).to_numpy(), batch.column(2).take(part).to_pylist()
                if held and len(held.keys() | set(keys)) > HELD_KEYS:
                    yield told(held)
                    held = {}
                for k in set(keys):
                    held.setdefault(k, np.zeros((2, rounds)))
                # A row without a name is told by its round alone.
                for unnamed, suffixes in ((False, joined), (True, numbers)):
                    at = [i for i, r in enumerate(rows) if (r is None) == unnamed]
                    if at:
                        add(held, [keys[i] for i in at], v[at], [(rows[i] or "").encode() for i in at], suffixes)
        if held:
            yield told(held)

    return sums


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, mean_diff, t, p) of the two-sided paired t test of b - a."""
    d = F.col(b) - F.col(a)
    row = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    told = row.select("n", "mean_diff", F.try_divide("mean_diff", F.col("sd") / F.sqrt("n")).alias("t"))
    return told.select("*", t_tail(F.col("t"), F.col("n") - 1).alias("p"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with 1-based ranks of value, ties sharing their mean rank.  Counts and their running sums are over distinct values only."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    upto = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(out, F.coalesce(F.sum("_n").over(upto), F.lit(0)) + (F.col("_n") + 1) / 2.0).drop("_n")
    return df.join(counts, value)


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (h, df, p) with tie correction."""
    ranked = average_ranks(df.where(F.col(value).isNotNull()), value, "_rank")
    groups = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("_rank").alias("r"))
    total = groups.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), (F.count("*") - 1).alias("df"))
    ties = df.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return total.join(ties).select(h.alias("h"), "df", chi2_tail(h, F.col("df")).alias("p"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson, Spearman and the linear fit of y on x."""
    ranked = average_ranks(average_ranks(df, x, "_rx"), y, "_ry")
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            out *= c * d
    return front * out


def _gamma_tail(s: float, x: float) -> float:
    """Upper regularised incomplete gamma function by series."""
    if x <= 0:
        return 1.0
    term = total = 1 / s
    for k in range(1, 2000):
        term *= x / (s + k)
        total += term
        if term < total * 1e-16:
            break
    return max(0.0, 1 - total * math.exp(-x + s * math.log(x) - math.lgamma(s)))


def t_tail(t: Column, df: Column) -> Column:
    def tail(ts: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([np.nan if pd.isna(x) or not d > 0 else _beta(d / 2, 0.5, d / (d + x * x)) for x, d in zip(ts, ds, strict=True)])

    return F.pandas_udf(tail, "double")(t, df.cast("double"))


def chi2_tail(x: Column, df: Column) -> Column:
    def tail(xs: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([np.nan if pd.isna(v) or not d > 0 else _gamma_tail(d / 2, v / 2) for v, d in zip(xs, ds, strict=True)])

    return F.pandas_udf(tail, "double")(x, df.cast("double"))
