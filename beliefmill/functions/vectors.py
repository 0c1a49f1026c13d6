"""Vector columns: row-level forms as higher-order functions, bulk forms as
Arrow batches handed to numpy inside the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal width, empty or zero vectors; null stays null."""
    size = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(usable, dot(a, b) / size).otherwise(F.lit(0.0))


def mean_of_two(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: (x + y) / 2.0)).otherwise(a)


def running_mean(mean: Column, x: Column, n: Column) -> Column:
    return F.when(
        (F.size(mean) == F.size(x)) & (n > 0),
        F.zip_with(mean, x, lambda m, v: m + (v - m) / n),
    ).otherwise(mean)


def matrix(col) -> np.ndarray:
    """Arrow list column (no nulls) -> 2-d float64 array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)
