"""Vectors as packed integer rows: floors of scaled components, exact products.

Rows without a vector, or with a null or non-finite component, take no part. Shorter vectors are filled with
zeros to the length of the longest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FAR = float(1 << 52)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & finite)


def extent(rows: DataFrame, vector: str) -> tuple[int, float]:
    """Length of the longest vector and largest absolute component; (0, 0.0) without rows."""
    top = rows.agg(
        F.max(F.size(vector)).alias("length"),
        F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))).alias("top"),
    ).first()
    return int(top["length"] or 0), float(top["top"] or 0.0)


def floored(column: pa.ListArray, scale: int, length: int) -> np.ndarray:
    """floor(scale * x) of every component as int64, one row per vector, zeros where a vector is short."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale).astype(np.int64)
    if len(sizes) and (sizes == length).all():
        return whole.reshape(len(sizes), length)
    out = np.zeros((len(sizes), length), dtype=np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at, within] = whole
    return out


def packed(values: np.ndarray) -> pa.Array:
    """Each row of an int32 matrix as one binary value."""
    data = np.ascontiguousarray(values, dtype="<i4")
    width = 4 * data.shape[1]
    offsets = np.arange(len(data) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(column: pa.Array, length: int) -> np.ndarray:
    """The int64 matrix that `packed` wrote."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros((len(column), length), dtype=np.int64)
    raw = np.frombuffer(data, dtype="<i4", offset=int(offsets[0]), count=int(offsets[-1] - offsets[0]) // 4)
    return raw.reshape(len(column), length).astype(np.int64)


def component_limit(length: int, total: int = 62) -> int:
    """Largest absolute component for which sums of `length` squared differences stay below 2 ** total."""
    return int((2 ** (total / 2 - 1)) / max(length, 1) ** 0.5) - 1


def check_range(top: float, scale: int, length: int) -> None:
    """An error where exact sums would not fit a long, the type of every result here."""
    limit = min(component_limit(length), (1 << 29) - 1)
    if top * scale + 1 > limit:
        raise ValueError(f"components up to {top:g} times {scale} pass {limit}: sums of {length} squares do not fit a long")
