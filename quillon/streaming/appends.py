"""Streaming forms of the append logs: resumable appends, last-wins upserts and windowed counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.tables import last_wins, upsert


def stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_new(source: DataFrame, keys: Sequence[str], out: str, checkpoint: str, time: str, delay: str = "1 hour") -> StreamingQuery:
    """Appends the first row of each key seen within the watermark; restarts go on where the checkpoint ends."""
    fresh = source.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_last(source: DataFrame, keys: Sequence[str], ordinal: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last row of each key: every batch writes a new version under folder, numbered by its batch."""

    def write(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, last_wins(batch, keys, ordinal)
        if number:
            old = spark.read.parquet(f"{folder}/{number - 1}")
            new = last_wins(old.unionByName(new), keys, ordinal) if ordinal in old.columns else upsert(old, new, keys)
        new.write.mode("overwrite").parquet(f"{folder}/{number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(source: DataFrame, time: str, key: str, size: str = "1 hour", slide: str | None = None, delay: str = "30 minutes") -> DataFrame:
    """(start, key, n): tumbling or sliding counts with a watermark; works on batch tables as well."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = source.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(window, key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), key, "n")


def sessions(source: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(start, until, key, n): sessions that end after a gap."""
    grouped = source.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("until"), key, "n")
