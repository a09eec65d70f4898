"""Vectors as exact integers: which rows count, and how a component becomes an integer.

A row counts if its vector has the asked number of components, none null or not finite.  A component x becomes
floor(256 * x), x as double.  Squared distances are 64-bit integers, so components saturate at +-2**27 (|x| = 524,288).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, LIMIT = 256, 1 << 27


def finite(vectors: DataFrame, dims: int) -> DataFrame:
    """Rows whose column `vector` counts; native expressions, so the filter stays in the scan's stage."""
    v = F.col("vector")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce((F.size(v) == dims) & whole, F.lit(False)))


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) int64 of a list column without nulls."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64).reshape(-1, dims)


def norms(m: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", m, m)


def squared(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """All squared distances, exact: |v|^2 - 2 v.c + |c|^2 in int64; terms wrap and their sum is right as it fits."""
    with np.errstate(over="ignore"):
        return norms(v)[:, None] - 2 * (v @ centres.T) + norms(centres)[None, :]


def floor_mean(sums, n: int) -> list[int]:
    """Componentwise floor(sum / n) of Python integers."""
    return [int(s) // n for s in sums]
