"""Relational operators of the pipeline's stages: keyed dedup, first-n, reconciliation, rollups, dataset assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of the final dataset, in order.
DATASET = ("category", "uuid", "asin", "cluster", "correct_query", "noisy_query", "error_pattern")


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The row with the largest ordinal of each key; map-side combined, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def first_n(df: DataFrame, key: str, order: Sequence[str], n: int, distinct: str | None = None) -> DataFrame:
    """The first n rows of each key by order, after keeping the first of equal values of distinct; place counts from 1."""
    if distinct is not None:
        rest = [c for c in df.columns if c not in (key, distinct)]
        ordered = [c for c in order if c in rest]
        firsts = df.groupBy(key, distinct).agg(F.min(F.struct(*ordered, *(c for c in rest if c not in ordered))).alias("_row"))
        df = firsts.select(key, distinct, *(F.col(f"_row.{c}").alias(c) for c in rest))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def merge_keep_old(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old, and the rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys on both sides, on the left alone, on the right alone."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    joined = a.join(b, list(keys), "full")
    return joined.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
    )


def require(df: DataFrame, name: str, holds: Column) -> DataFrame:
    """df; reading a row for which holds isn't true raises with name."""
    return df.where(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"expectation failed: {name}")).cast("boolean")))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df's key counts as an expectation: reading a key that occurs twice raises."""
    return require(df.groupBy(*keys).agg(F.count("*").alias("n")), f"{', '.join(keys)} unique", F.col("n") == 1)


def reviewed_products(products: DataFrame, reviews: DataFrame, tasks: int | None = None) -> DataFrame:
    """(asin, user_id): users that reviewed a product (asin, parent_asin) or one of its children.

    Reviews may repeat; they are read once and handed to their product and its parent, where products has that.  tasks is how
    many tasks look for repeats: as nearly all rows differ, each holds its own in memory, so it should grow with reviews.
    """
    up = products.where("asin != parent_asin").select("asin", F.col("parent_asin").alias("to"))
    up = up.join(products.select(F.col("asin").alias("to")), "to", "left_semi").select("asin", "to")
    links = products.select("asin", F.col("asin").alias("to")).unionByName(up).distinct()
    found = reviews.join(links, "asin").select(F.col("to").alias("asin"), "user_id")
    return (found if tasks is None else found.repartition(tasks, "asin", "user_id")).distinct()


def assemble(clean: DataFrame, noisy: DataFrame, clusters: DataFrame) -> DataFrame:
    """The final dataset: clean (category, uuid, asin, correct_query) with its user's cluster; noisy_query defaults to the clean one."""
    from quillon.functions.text import first_difference

    joined = clean.join(clusters, ["uuid", "asin"]).join(noisy, ["uuid", "asin"], "left")
    query = F.coalesce(F.nullif("noisy_query", F.lit("")), F.col("correct_query"))
    out = joined.withColumn("noisy_query", query).withColumn("error_pattern", first_difference(F.col("correct_query"), F.col("noisy_query")))
    return out.select(*DATASET)


def grouped_export(rows: DataFrame) -> DataFrame:
    """(category, uuid, asin, queries): the rows of a user and product as an array sorted by cluster and query."""
    one = F.struct("cluster", "correct_query", "noisy_query", "error_pattern")
    return rows.groupBy("category", "uuid", "asin").agg(F.array_sort(F.collect_list(one)).alias("queries"))


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, population deviation, min, quartiles and max."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return rows.select(*keys, "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max")
