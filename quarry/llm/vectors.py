"""Integer vectors as rows and as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this are not told apart by doubles; floors are clipped to it.
CLIP = 1 << 53


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def floored(vectors: DataFrame, scale: int, offset: int, *more: str) -> DataFrame:
    """vec_id, x (array of floor(scale * entry) + offset) and the columns `more`, of rows whose vector is finite."""
    clip = lambda n: F.least(F.greatest(n, F.lit(-CLIP).cast("long")), F.lit(CLIP).cast("long"))
    x = F.transform("embedding", lambda c: clip(F.floor(scale * c.cast("double"))) + F.lit(offset).cast("long"))
    return vectors.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), *more)


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the length, the numbers of its rows, and their vectors as a matrix of integers."""
    offsets = column.offsets.to_numpy()
    many, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(many).tolist():
        at = np.flatnonzero(many == d)
        yield d, at, flat[(offsets[:-1][at][:, None] + np.arange(d)[None, :]).ravel()].astype(np.int64).reshape(len(at), d)


def row_sums(squares_of: np.ndarray, weights: int = 1) -> list[int | None]:
    """Of each row, the sum of (weights * entry)**2 as an exact integer; None where a long cannot hold it."""
    top = int(np.abs(squares_of).max(initial=0)) * abs(weights)
    if squares_of.shape[1] * top * top < 1 << 63:
        return ((squares_of * weights) ** 2).sum(axis=1).tolist()
    sums = ((squares_of.astype(object) * weights) ** 2).sum(axis=1).tolist()
    return [int(s) if s < 1 << 63 else None for s in sums]
