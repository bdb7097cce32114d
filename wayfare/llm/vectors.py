"""Vectors as rows of arrays: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(column: str) -> Column:
    """Whether an array is there and all its components are finite numbers."""
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def keyed(vectors: DataFrame) -> DataFrame:
    """(key, vec_id, label, embedding) of all rows; ``key`` is unique, and settled only once the result is stored."""
    return vectors.select(
        F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """The arrays of a column as rows of a matrix; shorter ones are followed by zeros."""
    n = len(column)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    if (size == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), kind)
    out[np.arange(width) < size[:, None]] = flat
    return out
