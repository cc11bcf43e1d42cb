"""A compressed late-interaction index: centroids, residual codes of BITS bits, inverted lists of centroids, exact rescoring.

Each document token is its nearest centroid's number and, by dimension, the bucket
of what is left.  A query token probes the lists of its nearest centroids; the
documents found are ranked by the centroids' scores alone, the best of them by
decompressed tokens, and the best of those by their tokens as given, so the scores
returned are exact and only their candidates approximate.

Centroids and bucket bounds are fitted on a sample whose size is a parameter; every
token is indexed.  Centroids are handed to tasks, at most MAX_CELLS of them.
Documents without a token are in no list; queries without one have no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.retrieval import small, top_k
from quillon.operators.storage import writer

BITS = 2
MAX_CELLS = 65_536
MAX_FIT = 1 << 18
#: Scores of tokens by centroids that a task holds at once.
SCORES = 1 << 22


@dataclass(frozen=True)
class LateIndex:
    """codes: (doc_id, cells, codes) for each document; lists: (cell, doc_id), each pair once; centroids; bounds and values of buckets."""

    codes: DataFrame
    lists: DataFrame
    centroids: np.ndarray
    bounds: np.ndarray
    values: np.ndarray


def cells_for(tokens: int) -> int:
    """The number of centroids: a power of two near 4 times the root of the tokens."""
    return max(1, min(MAX_CELLS, 1 << round(math.log2(max(1.0, 4 * math.sqrt(tokens))))))


def pack(buckets: np.ndarray, bits: int = BITS) -> bytes:
    """Bucket numbers as bytes, bits each, first numbers in the low bits."""
    flat = buckets.astype(np.uint8).ravel()
    per = 8 // bits
    padded = np.pad(flat, (0, -len(flat) % per)).reshape(-1, per)
    return (padded << (np.arange(per, dtype=np.uint8) * bits)).sum(axis=1).astype(np.uint8).tobytes()


def unpack(codes: bytes, n: int, bits: int = BITS) -> np.ndarray:
    held = np.frombuffer(codes, np.uint8)
    return ((held[:, None] >> (np.arange(8 // bits, dtype=np.uint8) * bits)) & ((1 << bits) - 1)).ravel()[:n]


def nearest(tokens: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The place of each token's nearest centroid, for blocks of tokens of at most SCORES scores."""
    half, step = 0.5 * (centroids**2).sum(axis=1), max(1, SCORES // len(centroids))
    return np.concatenate([np.empty(0, np.int64), *((tokens[at : at + step] @ centroids.T - half).argmax(axis=1) for at in range(0, len(tokens), step))])


def matrix(rows) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in rows])


def build(docs: DataFrame, cells: int | None = None, bits: int = BITS, seed: int = 42, steps: int = 4, max_fit: int = MAX_FIT) -> LateIndex:
    """The index of docs (doc_id, toks array<array<float>>)."""
    if bits not in (1, 2, 4, 8):
        raise ValueError("bits must divide 8")
    write = writer(docs.sparkSession, "late-index")
    filled = docs.select("doc_id", "toks").where(F.size("toks") > 0)
    tokens = filled.select(F.explode("toks").alias("t")).select(F.transform("t", lambda x: x.cast("double")).alias("t"))
    cells = cells or cells_for(filled.agg(F.sum(F.size("toks"))).first()[0] or 1)
    # A limit leaves one part, in which one task would fit all centroids.
    sample = write(tokens.orderBy(F.xxhash64("t"), "t").limit(max_fit).repartition(4 * docs.sparkSession.sparkContext.defaultParallelism))
    model = KMeans(k=min(cells, MAX_CELLS), seed=seed, maxIter=steps, featuresCol="v").fit(sample.select(array_to_vector("t").alias("v")))
    centroids = np.array(model.clusterCenters())

    def left(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                own = matrix(frame["t"])
                yield pd.DataFrame({"x": (own - centroids[nearest(own, centroids)]).ravel()})

    n = 1 << bits
    shares = [k / (2 * n) for k in range(1, 2 * n)]
    found = np.array(sample.mapInPandas(left, "x double").approxQuantile("x", shares, 0.001))
    bounds, values = found[1::2], found[0::2]

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = [matrix(toks) for toks in frame["toks"]]
            if not held:
                continue
            own = np.concatenate(held)
            at = nearest(own, centroids)
            buckets, ends = np.searchsorted(bounds, own - centroids[at]), np.cumsum([len(m) for m in held])
            parts = [slice(end - len(m), end) for m, end in zip(held, ends, strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "cells": [at[x].tolist() for x in parts], "codes": [pack(buckets[x], bits) for x in parts]})

    codes = write(filled.mapInPandas(coded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, cells array<int>, codes binary"))
    lists = write(codes.select("doc_id", F.explode(F.array_distinct("cells")).alias("cell")))
    return LateIndex(codes, lists, centroids, bounds, values)


def decompressed(centroids: np.ndarray, values: np.ndarray, cells, codes: bytes, bits: int = BITS) -> np.ndarray:
    """A document's tokens as an index with these centroids and bucket values holds them."""
    at = np.asarray(cells)
    return centroids[at] + values[unpack(codes, len(at) * centroids.shape[1], bits).reshape(len(at), -1)]


def probed(index: LateIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, place, cell, s): for each query token its nearest centroids with their scores."""
    centroids = index.centroids

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for query_id, toks in zip(frame["query_id"], frame["toks"], strict=True):
                scores = matrix(toks) @ centroids.T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                out += [(query_id, place, int(c), float(scores[place, c])) for place, own in enumerate(best) for c in own]
            yield pd.DataFrame(out, columns=["query_id", "place", "cell", "s"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "toks").where(F.size("toks") > 0).mapInPandas(near, f"query_id {kind}, place int, cell int, s double")


def scored(pairs: DataFrame, tokens) -> DataFrame:
    """(query_id, doc_id, score) of pairs (query_id, doc_id, asked, ...): tokens(row) gives the document's matrix."""
    ids = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "doc_id"))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [float((matrix(row.asked) @ tokens(row).T).max(axis=1).sum()) for row in frame.itertuples()]
            yield pd.DataFrame({"query_id": frame["query_id"], "doc_id": frame["doc_id"], "score": np.array(found, np.float64)})

    return pairs.mapInPandas(score, f"{ids}, score double")


def search(index: LateIndex, docs: DataFrame, queries: DataFrame, k: int = 10, probes: int = 4, candidates: int = 256, rescored: int = 64, bits: int = BITS) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of queries (query_id, toks) over docs (doc_id, toks), the index's documents.

    A query token looks into probes lists; candidates documents a query go on to decompression, rescored of them to their given tokens.
    """
    rows = index.lists.join(probed(index, queries, probes), "cell")
    token = rows.groupBy("query_id", "doc_id", "place").agg(F.max("s").alias("s"))
    first = top_k(token.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score")), candidates).select("query_id", "doc_id")
    asked = small(queries.select("query_id", F.col("toks").alias("asked")))
    centroids, values = index.centroids, index.values
    second = scored(first.join(index.codes, "doc_id").join(asked, "query_id"), lambda row: decompressed(centroids, values, row.cells, row.codes, bits))
    kept = top_k(second, rescored).select("query_id", "doc_id")
    return top_k(scored(kept.join(docs.select("doc_id", "toks"), "doc_id").join(asked, "query_id"), lambda row: matrix(row.toks)), k)
