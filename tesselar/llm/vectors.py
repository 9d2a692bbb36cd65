"""Vectors of floats turned into whole numbers, so that products and distances are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is there and has no null, infinite or NaN component."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, odd), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays as an int64 matrix; short rows are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width and (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of arrays."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))
