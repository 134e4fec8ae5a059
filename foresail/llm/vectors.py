"""What the operators on vectors share: which vectors count, how they reach numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """A vector that is there, has components, and none that is null or not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & (F.size(vector) > 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of vectors of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), dtype=dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def shard_count(rows: Column, most: int, least: int, worth: int) -> Column:
    """Shards of at most ``most`` rows on average; ``least`` of them once there are
    ``worth`` rows for each, so that small tables also use several cores."""
    few = F.least(F.lit(least), F.ceil(rows / F.lit(worth)))
    return F.greatest(F.ceil(rows / F.lit(most)), few, F.lit(1)).cast("int")
