"""Rows of vectors as matrices of whole numbers; used by whitening and search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 2**63 - 1


def scaled(df: DataFrame, vector: str, scale: int) -> Column:
    """floor(scale * c) of each entry c, as long; null for a vector that is null or holds a null or a
    non-finite entry. What is beyond long is the nearest long."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return F.when(fine, F.transform(df[vector], lambda c: F.floor(c.cast("double") * F.lit(float(scale)))))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a column of lists as int64, one row each; shorter ones are followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    sizes = np.diff(starts)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def largest(x: np.ndarray) -> int:
    """The largest absolute value, as a Python number (the least long has none of its own)."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def to_long(x: np.ndarray) -> np.ndarray:
    """Python numbers as int64, each beyond it as the nearest."""
    return np.array([min(max(int(v), -LONG - 1), LONG) for v in x.reshape(-1)], np.int64).reshape(x.shape)
