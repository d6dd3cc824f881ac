"""Vectors as whole numbers, and exact arithmetic on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1 << 62  # components beyond it count as it
MOST = (1 << 63) - 1


def finite(vector: str) -> Column:
    """True for a vector without a null or non-finite component."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )


def whole(vector: str, scale: int = 256) -> Column:
    """Every component x as floor(scale * x)."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * scale))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists as rows of a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("int64").reshape(len(column), width)


def top(*arrays: np.ndarray) -> int:
    """The largest magnitude in any of them."""
    return max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with the columns of ``query``: in doubles or 64-bit integers
    where their size allows it, else in Python's integers."""
    reach = rows.shape[1] * top(rows) * top(query)
    if reach < 1 << 53:
        return (rows.astype("float64") @ query.astype("float64")).astype("int64")
    if reach < 1 << 63:
        return rows @ query
    return rows.astype(object) @ query.astype(object)
