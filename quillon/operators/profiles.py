"""User error profiles, token scoring and noise injection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import errors as er
from quillon.functions import text as tx


def error_profile(pairs: DataFrame) -> DataFrame:
    """(user_id, error_words, corrected_words, char_freq, bigram_freq, n_errors) from (user_id, original, corrected).

    Words are of single-token pairs; characters and bigrams of all wrong forms.
    Counts combine by (user, character) before maps are built.
    """
    single = ~F.col("original").contains(" ") & ~F.col("corrected").contains(" ") & (F.col("original") != "") & (F.col("corrected") != "")
    base = pairs.groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.when(single, F.lower("original")))).alias("error_words"),
        F.array_sort(F.collect_set(F.when(single, F.lower("corrected")))).alias("corrected_words"),
        F.count("*").alias("n_errors"),
    )

    def counted(values, name: str) -> DataFrame:
        each = pairs.select("user_id", F.explode(values).alias("x")).groupBy("user_id", "x").agg(F.count("*").alias("n"))
        return each.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("x", "n")))).alias(name))

    none = F.create_map().cast("map<string,bigint>")
    joined = base.join(counted(er.chars(F.col("original")), "char_freq"), "user_id", "left").join(counted(er.bigrams(F.col("original")), "bigram_freq"), "user_id", "left")
    return joined.withColumn("char_freq", F.coalesce("char_freq", none)).withColumn("bigram_freq", F.coalesce("bigram_freq", none))


def scored_tokens(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """(query_id, user_id, place, token, score) of queries (query_id, user_id, text, values), best first by rank."""
    tokens = queries.select("query_id", "user_id", "values", F.posexplode(tx.query_tokens(F.col("text"))).alias("place", "token"))
    joined = tokens.join(profiles, "user_id")
    scored = joined.withColumn("score", F.round(er.token_score(F.col("token"), F.col("error_words"), F.col("char_freq"), F.col("bigram_freq"), F.col("values")), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place")
    return scored.withColumn("rank", F.row_number().over(order)).select("query_id", "user_id", "place", "token", "score", "rank")


def inject(queries: DataFrame, history: DataFrame) -> DataFrame:
    """(query_id, clean_query, noisy_query, selected_token, original, corrected, status): the first token of a query that
    resembles one of its user's past errors (history: user_id, errors array of (original, corrected), in order) takes its wrong form."""
    tokens = queries.select("query_id", "user_id", "text", F.posexplode(tx.query_tokens(F.col("text"))).alias("place", "token"))
    joined = tokens.join(history, "user_id")
    hit = F.get(F.filter("errors", lambda e: er.matches_error(F.col("token"), e["original"])), F.lit(0))
    matched = joined.withColumn("hit", hit).where("hit is not null")
    first = matched.groupBy("query_id").agg(F.min_by(F.struct("token", "hit"), "place").alias("m"))
    out = queries.join(first, "query_id", "left")
    noisy = F.when(F.col("m").isNotNull(), er.replace_first(F.col("text"), F.col("m.token"), F.col("m.hit.original"))).otherwise(F.col("text"))
    return out.select(
        "query_id",
        F.col("text").alias("clean_query"),
        noisy.alias("noisy_query"),
        F.col("m.token").alias("selected_token"),
        F.col("m.hit.original").alias("original"),
        F.col("m.hit.corrected").alias("corrected"),
        F.when(F.col("m").isNull(), "no_match").when(noisy == F.col("text"), "unchanged").otherwise("rewritten").alias("status"),
    )


def valid_injections(pairs: DataFrame) -> DataFrame:
    """pairs (noisy_query, injected array<string>, known array<string>) with kept (injected errors that are known and present) and valid."""
    kept = F.filter("injected", lambda e: F.array_contains(F.transform("known", F.lower), F.lower(e)) & F.contains(F.lower("noisy_query"), F.lower(e)))
    return pairs.withColumn("kept", kept).withColumn("valid", (F.size("known") == 0) | (F.size("kept") > 0))
