"""Vector expressions over array columns, and their matrix counterparts over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(a: Column) -> Column:
    """a at length 1; zero vectors stay zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where one side is all zeros."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def is_usable(c: Column, dim: int) -> Column:
    """True for arrays of dim numbers, not all zero."""
    return F.coalesce(c.isNotNull() & (F.size(c) == dim) & F.exists(c, lambda x: x != 0), F.lit(False))


def rows_of(col: pa.Array, dim: int) -> np.ndarray:
    """A column of arrays of dim numbers as a matrix of doubles."""
    flat = col.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)
