"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch of texts at most, so that a Python worker holds few whole texts at a time.
TEXT_ROWS = 1000
#: The separators between words, and the complement of a word character, as Java patterns.
SPACES = "[\\x20\\x09-\\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame) -> DataFrame:
    """df, after making sure that its session passes texts to Python TEXT_ROWS rows at a time or fewer.

    Spark bounds a batch's bytes as well (maxBytesPerBatch, 64 MB unless the session says otherwise); a longer text is a batch
    of its own.  The setting is read when a query runs, which may be long after it was built: it stays lowered.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


Batches = Iterator[pa.RecordBatch]


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df through function, batch by batch.  Ids and other columns that function hands on stay Arrow arrays, so wide ids beside nulls keep their value."""

    def batches(found: Batches) -> Batches:
        for batch in found:
            yield from function(batch)

    return text_batches(df).mapInArrow(batches, schema)


def text_parts(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters each."""
    low = held = 0
    for at, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield low, at + 1
            low, held = at + 1, 0
    if low < len(texts):
        yield low, len(texts)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables: spark.checkpoint.dir; where it is unset, a new local one in local mode only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if named is None and current.isDefined():
        named = current.get()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillon-checkpoint-")
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named


#: Open scopes of written tables, innermost last; queries built in other threads have their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder, so a lost executor costs no recomputation from the source: a checkpoint, inside scratch() a table."""
    if _scopes.get():
        return written(df)[0]
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, which is smaller than a checkpoint of many narrow rows; and the table's path."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def numbered(df: DataFrame, order: list[Column | str]) -> tuple[DataFrame, int]:
    """df as a written table with ``at``, each row's place from 0 in the given order, and the number of rows; equal rows are in any order.

    Ranges of rows are sorted apart and numbered by the rows of the ranges before them: one count a range passes through the driver.
    Rows equal in the order are dealt by a number of their own, so that no range need hold them all.  df itself is written first, as
    Spark reads it twice, to find ranges and to deal.
    """
    own = written(df.withColumn("own_number", F.monotonically_increasing_id()))[0]
    keys = [*order, "own_number"]
    dealt = own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("own_number").withColumn("at", F.monotonically_increasing_id())
    # at is the range's number times 2**33 and the place in the range.
    ranges, size = written(dealt)[0], 1 << 33
    offsets, total = [], 0
    for row in sorted(ranges.groupBy(F.shiftright("at", 33).cast("int").alias("part")).count().collect()):
        offsets.append((row.part, total))
        total += row["count"]
    shift = df.sparkSession.createDataFrame(offsets, "part int, before long")
    found = ranges.withColumn("part", F.shiftright("at", 33).cast("int")).join(F.broadcast(shift), "part")
    return found.withColumn("at", F.col("before") + F.col("at") % size).select(*df.columns, "at"), total


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go when it ends.  What reads them and shall outlive it passes through the function that it gives, which cuts it loose."""
    outer, own = _scopes.get(), []
    _scopes.set((*outer, own))

    def outlive(df: DataFrame) -> DataFrame:
        _scopes.set(outer)
        try:
            return cut(df)
        finally:
            _scopes.set((*outer, own))

    try:
        yield outlive
    finally:
        _scopes.set(outer)
        for path in own:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def rows_of(docs: DataFrame, *columns: Column) -> DataFrame:
    """(d, row, columns): each row of docs whole, as a struct that no name can clash with, beside a number of its own.

    The number is stable only once the result is written.
    """
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.monotonically_increasing_id().alias("row"), *columns)


def whole(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of rows_of(docs) as docs had them."""
    return rows.select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))


def flagged(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows with ``hit``: whether chosen holds their row number.  Numbers are broadcast as bits, 64 to a long, so that rows not
    chosen keep their texts out of the shuffle of a join."""
    bits = chosen.groupBy(F.shiftright("row", 6).alias("block")).agg(F.expr("bit_or(shiftleft(1L, CAST(row & 63 AS INT)))").alias("bits"))
    held = rows.withColumn("block", F.shiftright("row", 6)).join(F.broadcast(bits), "block", "left")
    return held.select(*rows.columns, F.coalesce(F.getbit("bits", F.expr("CAST(row & 63 AS INT)")) == 1, F.lit(False)).alias("hit"))


def space_words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
