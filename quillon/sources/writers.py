"""Sinks.  Spark's commit protocol makes each write appear as a whole or not at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "error") -> None:
    """JSON lines with columns in the given order."""
    (df.select(*columns) if columns else df).write.mode(mode).json(path)


def partitioned(df: DataFrame, path: str, by: Sequence[str] = ("category",), mode: str = "error") -> None:
    """Parquet, one folder a value of by; rows of a value go to one writer only as far as AQE finds them small."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def collection_tsv(docs: DataFrame, path: str, mode: str = "error") -> None:
    """pid, tab, text: dense ids in doc_id order, control characters as spaces; an empty text raises.

    Ids come from counts of each range partition, so no single task numbers all rows.
    """
    clean = F.trim(F.regexp_replace("text", "[\\n\\r\\t]+", " "))
    checked = F.when(clean != "", clean).otherwise(F.raise_error(F.lit("empty document text")))
    ordered = docs.select("doc_id", checked.alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id()).persist()
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1
    ordered.withColumn("place", place).join(starts, "part").select((F.col("start") + F.col("place")).alias("pid"), "text").write.mode(mode).option("sep", "\t").option("quote", "").csv(path)
    ordered.unpersist()
