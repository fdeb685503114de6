"""Vectors as integers, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def integers(column: pa.ListArray, scale: int, dims: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that hold a vector of that many components, none null, non-finite or beyond the limit, and floor(scale * x)
    of their components."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)))
    x = np.asarray(column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), dims)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
        good = (np.abs(x) <= limit).all(axis=1)  # false for NaN and infinity
    return rows[good], x[good].astype(np.int64)
