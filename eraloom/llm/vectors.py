"""Helpers for tables of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T


def usable(vector: str | Column) -> Column:
    """Whether a vector takes part: not null, not empty or zero, no null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


@F.pandas_udf(T.BinaryType())
def fingerprint(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """128-bit fingerprint of a vector's values; equal vectors have equal ones."""
    for s in series:
        yield pd.Series([None if v is None else xxhash.xxh3_128_digest((np.asarray(v, dtype=np.float64) + 0.0).tobytes()) for v in s], dtype=object)


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of vectors of one length, in double precision."""
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    n = len(column)
    return np.array(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))
