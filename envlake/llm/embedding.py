"""Vectors as exact integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A scaled component beyond this is an error: sums of 64 products would leave 64-bit integers.
LARGEST = 1 << 27


def finite(vec: Column, dim: int) -> Column:
    """Whether a vector has exactly ``dim`` components, none null or non-finite."""
    return F.coalesce((F.size(vec) == dim) & ~F.exists(
        vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def scaled(vec: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component ``x`` as a double; an error beyond :data:`LARGEST`."""
    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LARGEST, y).otherwise(
            F.raise_error(F.lit(f"a vector component is beyond {LARGEST} / {scale}"))).cast("int")
    return F.transform(vec, one)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of integers, all of length ``dim``, as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``, exact: in doubles where they hold
    every sum, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def ints(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column of 32-bit integers."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), pa.int32()), pa.array(rows.reshape(-1), pa.int32()))
