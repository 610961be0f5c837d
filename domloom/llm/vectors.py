"""Vectors as packed rows: between an Arrow column of binary values and a matrix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    usual = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & usual, F.lit(False))


def packed(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(matrix)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = (np.arange(len(rows) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, dtype: str) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].copy().view(dtype).reshape(n, -1)


def widths(column: pa.Array) -> np.ndarray:
    """Bytes of each binary value."""
    return np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1])


def listed(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def runs(columns: Sequence[pa.Array]) -> Iterator[tuple[tuple, slice]]:
    """Stretches of neighbouring rows that are equal in all ``columns``, with their values."""
    n = len(columns[0])
    if not n:
        return
    changed = np.zeros(n - 1, dtype=bool)
    codes = []
    for column in columns:
        if pa.types.is_string(column.type):
            column = column.dictionary_encode()
            codes.append((column.indices.to_numpy(zero_copy_only=False), column.dictionary))
        else:
            codes.append((column.to_numpy(zero_copy_only=False), None))
        changed |= codes[-1][0][1:] != codes[-1][0][:-1]
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
    for low, high in zip(cuts, cuts[1:]):
        yield tuple(int(v[low]) if names is None else names[int(v[low])].as_py() for v, names in codes), slice(low, high)


def merged(labels: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``labels`` (each the index of a root, roots label themselves) after joining the places
    ``one`` with the places ``two``; a group takes its smallest root."""
    while True:
        left, right = labels[one], labels[two]
        differ = left != right
        if not differ.any():
            return labels
        one, two, left, right = one[differ], two[differ], left[differ], right[differ]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further
        labels = parent[labels]


def grouped(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """Neighbouring rows equal in the first ``keys`` columns, across batches, with the other columns;
    with ``most`` in stretches of about so many rows."""
    key, parts, size = None, [], 0
    for batch in batches:
        for own, rows in runs(batch.columns[:keys]):
            if parts and (own != key or most and size >= most):
                yield key, [pa.concat_arrays(c) for c in zip(*parts)]
                parts, size = [], 0
            key = own
            parts.append([c[rows] for c in batch.columns[keys:]])
            size += rows.stop - rows.start
    if parts:
        yield key, [pa.concat_arrays(c) for c in zip(*parts)]
