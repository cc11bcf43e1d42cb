"""Tables that iterative operators write to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new local folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-tables-")
    return folder


#: Bytes of a batch of rows that goes to Python.
BATCH = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches of at most about BATCH bytes go to Python; without, one holds 10,000 rows of any length.  The setting stays, as queries run after they are built."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name, None)
    if given is None or not given.isdigit() or int(given) > BATCH:
        spark.conf.set(name, str(BATCH))


def writer(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a DataFrame as a Parquet table of its own and gives it as read again: its lineage is cut, its size known."""
    folder = shared_folder(spark)

    def write(df: DataFrame) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write
