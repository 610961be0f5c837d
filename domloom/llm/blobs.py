"""Sums of long vectors over all tasks, without passing them through the driver one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts per row; a row of 8-byte counts is 64 KB.
SLICE = 8192

#: First-level sums per slice.
SALTS = 64

SCHEMA = "slice int, salt int, counts binary"
ARROW = pa.schema([("slice", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])


def sliced(counts: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """What a task emits for its share: the vector as rows of ``SCHEMA``."""
    parts = [counts[i : i + SLICE] for i in range(0, len(counts), SLICE)]
    rows = [{"slice": k, "salt": salt % SALTS, "counts": p.astype("<i8").tobytes()} for k, p in enumerate(parts) if p.any()]
    yield pa.RecordBatch.from_pylist(rows, ARROW)


def summed(rows: DataFrame, length: int) -> np.ndarray:
    """The sum of all tasks' vectors: added up by (slice, salt), then by slice, in streams that
    hold one row per key. Only the sum, whose size is fixed, reaches the driver."""
    rows = rows.repartition("slice", "salt").mapInArrow(_add, SCHEMA)
    rows = rows.withColumn("salt", F.lit(0)).repartition("slice").mapInArrow(_add, SCHEMA)
    total = np.zeros(length, dtype=np.int64)
    for row in rows.collect():
        part = np.frombuffer(row["counts"], dtype="<i8")
        total[row["slice"] * SLICE : row["slice"] * SLICE + len(part)] += part
    return total


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(row["counts"], dtype="<i8")
            key = (row["slice"], row["salt"])
            if key in sums:
                sums[key] += part
            else:
                sums[key] = part.copy()
    for (number, salt), counts in sums.items():
        yield pa.RecordBatch.from_pylist([{"slice": number, "salt": salt, "counts": counts.tobytes()}], ARROW)
