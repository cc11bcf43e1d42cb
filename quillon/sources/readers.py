"""Readers.  Malformed records are kept apart, not lost; order is explicit where it matters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEWS = "user_id string, asin string, text string, reviewText string, summary string, vote string, overall double, verified boolean"
PRODUCTS = "asin string, parent_asin string, title string, brand string, store string, price string, category array<string>, categories array<string>, feature array<string>, features array<string>, description string, details string, also_buy array<string>, also_view array<string>, rank string"
QA = "asin string, questionType string, question string, answer string, answerType string, answerTime string"


def json_lines(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """JSON lines, plain or gzipped by suffix, with _corrupt_record for malformed ones; gzip isn't splittable, so partitions spreads it."""
    kept = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    df = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.repartition(partitions) if partitions else df


def well_formed(df: DataFrame) -> DataFrame:
    return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def reviews(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(user_id, asin, text, summary, vote, overall, verified) of both schema versions, rows with user and product."""
    df = well_formed(json_lines(spark, path, REVIEWS, partitions).persist())
    votes = F.translate("vote", ",", "").try_cast("int")
    out = df.select("user_id", "asin", F.coalesce("text", "reviewText").alias("text"), "summary", F.coalesce(votes, F.lit(0)).alias("vote"), "overall", "verified")
    return out.where("coalesce(user_id, '') != '' and coalesce(asin, '') != ''")


def products(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(key, title, brand, price, categories, features, description, details, also_buy, also_view, rank) of both schema versions."""
    df = well_formed(json_lines(spark, path, PRODUCTS, partitions).persist())
    named = lambda key: detail(F.col("details"), key)
    brand = F.coalesce(F.nullif("brand", F.lit("")), named("Brand"), named("brand"), F.col("store"))
    out = df.select(
        F.coalesce(F.nullif("asin", F.lit("")), "parent_asin").alias("key"), "title", brand.alias("brand"), "price",
        F.coalesce("categories", "category").alias("categories"), F.coalesce("features", "feature").alias("features"),
        "description", "details", "also_buy", "also_view", "rank",
    )
    return out.where("coalesce(key, '') != ''")


def detail(details: Column, key: str) -> Column:
    """A field of a JSON text; null for malformed text or a missing field."""
    return F.try_variant_get(F.try_parse_json(details), f'$["{key}"]', "string")


def questions(spark: SparkSession, path: str, max_per_product: int = 25) -> DataFrame:
    """(asin, qa): the first question-answer pairs of each product; single-quoted records are read, never evaluated."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ordinal"))
    parsed = lines.select("ordinal", F.from_json("value", QA, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}).alias("q")).select("ordinal", "q.*")
    kept = parsed.where("coalesce(question, '') != '' and coalesce(answer, '') != '' and asin is not null")
    listed = kept.groupBy("asin").agg(F.array_sort(F.collect_list(F.struct("ordinal", "question", "answer"))).alias("qa"))
    return listed.withColumn("qa", F.slice("qa", 1, max_per_product))


def concatenated_json(spark: SparkSession, path: str, salvage: bool = False) -> DataFrame:
    """(file, ordinal, record): the objects of files that hold one array or objects one after another, as JSON texts.

    Damaged text raises unless salvage is set, which then skips to the next brace.
    """

    def objects(text: str) -> Iterator[str]:
        decoder, at = json.JSONDecoder(), 0
        while at < len(text):
            if text[at].isspace() or text[at] == ",":
                at += 1
                continue
            try:
                value, at = decoder.raw_decode(text, at)
            except ValueError:
                if not salvage:
                    raise
                found = text.find("{", at + 1)
                if found < 0:
                    return
                at = found
                continue
            for item in value if isinstance(value, list) else [value]:
                yield json.dumps(item, ensure_ascii=False)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, text in zip(frame["file"], frame["value"], strict=True):
                rows = list(objects(text))
                yield pd.DataFrame({"file": name, "ordinal": range(len(rows)), "record": rows})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(batches, "file string, ordinal long, record string")


def records(raw: DataFrame, schema: str) -> DataFrame:
    """The rows of (file, ordinal, record) under a schema; a {records: [...]} wrapper is opened."""
    wrapped = F.from_json("record", f"struct<records:array<{schema}>>")["records"]
    one = F.array(F.from_json("record", schema))
    return raw.select("file", "ordinal", F.posexplode(F.coalesce(wrapped, one)).alias("place", "r")).select("file", "ordinal", "place", "r.*")


def model_response(text: Column, schema: str) -> Column:
    """The outer JSON object of a model's reply under a schema: fences dropped, braces balanced; null if it can't be parsed."""
    body = F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), "(?s)(\\{.*)", 1)
    lack = F.greatest(F.regexp_count(body, F.lit("\\{")) - F.regexp_count(body, F.lit("\\}")), F.lit(0))
    whole, mended = F.regexp_extract(body, "(?s)(\\{.*\\})", 1), F.concat(body, F.repeat(F.lit("}"), lack))
    sound = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(sound(whole), sound(mended))
