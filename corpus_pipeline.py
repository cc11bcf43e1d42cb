"""The corpus pipeline: language ID, near-duplicates, repeated passages, mixing, tokens.

Each stage works on what its predecessor kept; stages are written and read
again as Parquet by whoever runs them one by one, and run() does the same in the
shared checkpoint folder.

Defined cases: rows without a letter of any language, null and empty texts among
them, go in the first stage; of near copies, equal rows included, one row stays;
rows without an id are documents like others and come last among copies; columns
beyond those of documents pass through all stages but the last, whatever their
names; very long texts pass whole; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, langid, mixing, simhash, suffix_dedup
from quillon.llm.common import checkpoint_dir, delete, scratch, table

STAGES = [
    ("language_id", langid.keep_identified),
    ("simhash_near_dedup", simhash.keep_first),
    ("suffix_array_dedup", suffix_dedup.cut_stage),
    ("mixing", mixing.sample_stage),
    ("bpe", bpe.encode_stage),
]

#: Several stages have no SQL form; tests/llm holds run() against plain Python over a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.

    Each stage's rows are written to the shared checkpoint folder and its own tables deleted; the folder of a stage
    goes when the next has been written.  That of the last written stage stays, since the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
