"""Importance resampling of documents toward a target distribution, by hashed n-gram features.

A feature is a run of one to three consecutive words, joined by single spaces,
and falls into the bucket of its bytes' CRC-32.  All documents give s of their S
features to a bucket, the target texts t of their T.  A bucket's gain is the
floored log ratio of both shares (smoothed by one a bucket), a document's weight
the sum of its features' gains.  Adding Gumbel noise to the weights and taking
the greatest scores draws documents without replacement by their importance.

The hashing is a byte automaton over the UTF-8 buffer of an Arrow column: a
lookup table says which bytes belong to words, differences of neighbouring
classes give the words' bounds, and the CRCs of all words of a batch advance one
byte a step, through the CRC table.  A feature of two or three words carries the
state of its first words on through a space and the next word.

Counting sends one row a bucket and task; buckets are a parameter, so the gains
have a fixed size.  Texts are hashed twice, to count and to weigh, instead of
being written.  The draw sorts narrow rows by range and numbers them by the
offsets of their partitions, so that no task sees all.

Defined cases: null and empty texts, and texts without words, have no feature
and weight zero, but a score of noise; a document with fewer than ``least``
words is never drawn; a null doc_id is hashed as an empty one and loses ties; of
rows with one doc_id and one score any goes first; a text is never cut, however
long; without documents the result is empty, without target texts all gains
follow from t = T = 0; other columns are ignored, or kept whole by draw().
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import cut, numbered, rows_of, scratch, table, text_batches, whole

BUCKETS = 10_000
GRAM = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Bytes of a word beyond so many go through the C library's CRC, one word at a time.
STEPS = 64
#: Words that share the steps of a CRC.
LANES = 1 << 17

SPACE = 0x20


def _crc_table() -> np.ndarray:
    entries = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        entries = np.where(entries & 1, (entries >> 1) ^ np.uint32(0xEDB88320), entries >> 1)
    return entries


CRC = _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Digits, letters and all bytes beyond ASCII belong to words.
IN_WORD = np.zeros(256, np.int8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    IN_WORD[_low : _high + 1] = 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's buffer and the n + 1 offsets of its values in them; nulls have no bytes."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths, counts): lower-cased bytes with a space after each text, its words' places in them, and the words of each text."""
    spaced = LOWER[np.insert(data, offsets[1:], SPACE)]
    turns = np.diff(IN_WORD[spaced], prepend=np.int8(0))
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    edges = np.searchsorted(starts, offsets + np.arange(len(offsets)))
    return spaced, starts, ends - starts, np.diff(edges)


def advance(states: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after the spans of data, all spans one byte a step; the longest come first, so that those still going are a prefix."""
    order = np.argsort(-np.minimum(lengths, STEPS + 1).astype(np.int16), kind="stable")
    at, now = starts[order], states[order]
    going = np.searchsorted(-lengths[order].clip(max=STEPS + 1), -np.arange(STEPS + 1), "left")
    for step in range(STEPS):
        n = going[step]
        if not n:
            break
        part = now[:n]
        now[:n] = CRC[part.astype(np.uint8) ^ data[at[:n] + step]] ^ (part >> np.uint32(8))
    out = np.empty_like(now)
    out[order] = now
    for k in np.flatnonzero(lengths > STEPS):
        rest = data[starts[k] + STEPS : starts[k] + lengths[k]]
        out[k] = zlib.crc32(rest, int(out[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


class Features(NamedTuple):
    """Buckets of a run of words: by gram length, the bucket of the feature that starts at each word and whether it stays in its text."""

    buckets: list[np.ndarray]
    inside: list[np.ndarray]
    low: int
    high: int


def features(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS, gram: int = GRAM) -> Iterator[Features]:
    """The features of all words of word_bounds(), LANES first words at a time."""
    #: How many words the text still has from each word on.
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(starts))
    for low in range(0, len(starts), LANES):
        high = min(low + LANES, len(starts))
        states = np.full(high - low, 0xFFFFFFFF, np.uint32)
        found, inside = [], []
        for n in range(gram):
            on = left[low:high] > n
            lanes = np.flatnonzero(on)
            grown = states[lanes]
            if n:
                grown = CRC[grown.astype(np.uint8) ^ np.uint8(SPACE)] ^ (grown >> np.uint32(8))
            states[lanes] = advance(grown, data, starts[low + n + lanes], lengths[low + n + lanes])
            found.append(((states ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
            inside.append(on)
        yield Features(found, inside, low, high)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, gram: int = GRAM) -> np.ndarray:
    """How many features of column text fall into each bucket: a task adds up its own and passes on one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in features(*word_bounds(*utf8(batch.column(0))), buckets, gram):
                for bucket, inside in zip(part.buckets, part.inside, strict=True):
                    total += np.bincount(bucket[inside], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    found = text_batches(texts.select("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored 1,000-fold log ratio of the target's and the source's smoothed shares of each bucket."""
    n, all_source, all_target = float(len(source)), float(source.sum()), float(target.sum())
    ratios = ((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """The 1,000-fold Gumbel draw that belongs to an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """(d, n_words, n_features, weight, score) for each row of docs, whole in struct d."""
    buckets = len(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            data, starts, lengths, counts = word_bounds(*utf8(rows.field("text")))
            sums, held = np.zeros(len(starts) + 1, np.int64), np.zeros(len(starts) + 1, np.int64)
            for part in features(data, starts, lengths, counts, buckets, gram):
                for bucket, inside in zip(part.buckets, part.inside, strict=True):
                    sums[part.low + 1 : part.high + 1] += np.where(inside, gains[bucket], 0)
                    held[part.low + 1 : part.high + 1] += inside
            ends = np.append(0, np.cumsum(counts))
            weights, n_features = np.diff(np.cumsum(sums)[ends]), np.diff(np.cumsum(held)[ends])
            scores = weights + np.array([noise(i, seed) for i in rows.field("doc_id").to_pylist()], np.int64)
            columns = [rows, *(pa.array(x.astype(np.int64)) for x in (counts, n_features, weights, scores))]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "n_words", "n_features", "weight", "score"])

    schema = T.StructType([T.StructField("d", docs.schema, False), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    return text_batches(rows_of(docs).select("d")).mapInArrow(score, schema)


def ranked(rows: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """rows (doc_id, n_words, score and others) with rank: 1, 2, 3, ... for the greatest scores of the given share of rows with at least so many words, else null."""
    able = F.col("n_words") >= least
    numbers, _ = numbered(rows.withColumn("unable", ~able), ["unable", F.desc("score"), F.asc_nulls_last("doc_id")])
    drawn = numbers.where(able).count() * percent // 100
    return numbers.withColumn("rank", F.when(F.col("at") < drawn, F.col("at") + 1)).drop("at", "unable")


def fit(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, gram: int = GRAM) -> np.ndarray:
    return bucket_gains(bucket_counts(docs, buckets, gram), bucket_counts(target, buckets, gram))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """The documents drawn, whole and with their columns, in no order."""
    with scratch(docs.sparkSession) as outlive:
        rows = cut(scored(docs, fit(docs, target)))
        found = ranked(rows.withColumn("doc_id", F.col("d.doc_id").cast("long")), percent, least).where("rank IS NOT NULL")
        return outlive(whole(found, docs))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gains = fit(docs, table(spark, sf_dir, "benchmark"))
    with scratch(spark) as outlive:
        rows = cut(scored(docs, gains).select(F.col("d.doc_id").alias("doc_id"), "n_words", "n_features", "weight", "score"))
        return outlive(ranked(rows).select("doc_id", "n_features", "weight", "score", "rank"))
