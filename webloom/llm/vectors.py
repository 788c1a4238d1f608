"""Whole-number vectors for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubles below this hold every whole number; products of a block that stay below are exact in floating point.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """True for a vector that is there and has no null, NaN or infinite entry."""
    x = lambda e: e.cast("double")
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda e: e.isNull() | F.isnan(x(e)) | (F.abs(x(e)) == float("inf"))), F.lit(False))


def whole(vector: Column, factor: int, shift: int = 0) -> Column:
    """Each entry c, as double, as the long floor(factor * c) + shift; what lies beyond a long is the long next to it."""
    return F.transform(vector, lambda e: F.greatest(F.least(F.floor(e.cast("double") * float(factor)), F.lit(LONG - abs(shift))), F.lit(abs(shift) - LONG)) + F.lit(shift))


def matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    """A column of arrays of ``d`` longs as a matrix, a row each."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(col), d)


def largest(m: np.ndarray) -> int:
    """The greatest absolute value, 0 of nothing."""
    return max(int(m.max()), -int(m.min())) if m.size else 0


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of whole numbers without rounding: doubles where they hold every sum, else limbs of 16 bits in Python's integers."""
    if largest(a) * largest(b) * max(a.shape[1], 1) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).astype(object)
    out = np.zeros((a.shape[0], b.shape[1]), object)
    parts = lambda m: [((m >> (16 * k)) & 0xFFFF if k < 3 else m >> 48).astype(np.float64) for k in range(4)]
    pa_, pb = parts(a), parts(b)
    for at in range(0, a.shape[1], 1 << 20):
        for k, x in enumerate(pa_):
            for j, y in enumerate(pb):
                out += (x[:, at : at + (1 << 20)] @ y[at : at + (1 << 20)]).astype(np.int64).astype(object) << (16 * (k + j))
    return out
