"""Columns of vectors: which take part, and their values as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import column


def finite_vector(name: str) -> Column:
    """True for a vector that is not null and whose components are neither null, NaN nor infinite."""
    largest = F.lit(float("inf"))
    return F.coalesce(F.forall(column(name), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < largest)), F.lit(False))


def longest(vectors: DataFrame, name: str) -> int:
    """Components of the longest vector; 0 without rows."""
    return vectors.agg(F.max(F.size(column(name)))).first()[0] or 0


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors in double precision, one in each row; a shorter one goes on with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(lists) * width:
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
