"""Sums of long vectors over all rows, for statistics that a task can add up by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts in which a task's sums travel, so that adding them up is dealt as well.
CHUNKS = 16


def vector_sum(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of of(batch), a vector of that size, over all batches of rows; zeros without rows.  What meets on the driver is one vector."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield parts_of(list(range(CHUNKS)), np.array_split(total, CHUNKS))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, own in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                held[k] = held.get(k, 0.0) + np.array(own)
        yield parts_of(list(held), list(held.values()))

    def parts_of(keys: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], names=["part", "sums"])

    schema = "part int, sums array<double>"
    found = rows.mapInArrow(local, schema).repartition("part").mapInArrow(added, schema).collect()
    return np.concatenate([np.array(r.sums, np.float64) for r in sorted(found)]) if found else np.zeros(size)


def matrix(column: pa.Array) -> np.ndarray:
    """An array column whose rows are equally long, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
