"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null or empty, not zero, all components finite."""
    infinite = F.lit(float("inf"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def parts(n: str, size: int) -> Column:
    """In how many parts of about ``size`` rows a group of n rows is cut."""
    return F.ceil(F.col(n) / size).cast("int")


def part_of(key: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n).cast("int")
