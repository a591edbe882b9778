"""Integer vectors: which rows of a table of embeddings take part, and products that stay exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2**63 - 1


def finite(vector: str) -> Column:
    """Whether an array is there and none of its components is null, NaN or infinite."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def scaled(vector: str, by: int) -> Column:
    """floor(by * x) of every component as a long; beyond the range of a long it is the range's end."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * by))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of longs as an int64 matrix; shorter lists are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy().astype(np.int64)
    size, values = np.diff(ends), column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    width = int(size.max(initial=0))
    if len(size) and (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - (ends[:-1] - ends[0])[row]] = values
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.hstack([m, np.zeros((len(m), width - m.shape[1]), m.dtype)])


def largest(m: np.ndarray) -> int:
    return max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int64 matrices of one width, as longs; beyond their range, its end.

    Where every partial sum is below 2**53 the product in doubles is exact and fast; below 2**63 the one in
    longs; beyond, Python's integers.
    """
    bound = a.shape[1] * largest(a) * largest(b)
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound <= LIMIT:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LIMIT, LIMIT).astype(np.int64)


def squared_distances(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of the rows of p to the rows of c, as longs; beyond their range, its end."""
    bound = p.shape[1] * (largest(p) + largest(c)) ** 2
    if bound < 2**51:
        p, c = p.astype(np.float64), c.astype(np.float64)
        return ((p * p).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (p @ c.T)).astype(np.int64)
    if bound >= 2**63:
        p, c = p.astype(object), c.astype(object)
    d = np.stack([((p - row) ** 2).sum(1) for row in c], 1)
    return np.minimum(d, LIMIT).astype(np.int64)


def valid(embeddings: DataFrame) -> DataFrame:
    """The rows whose vector is there and finite in every component."""
    return embeddings.where(finite("embedding"))
