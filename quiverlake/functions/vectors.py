"""Vector columns: distance expressions for Catalyst, and matrices for Arrow kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
METRICS = ("l2", "cosine")


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: ColumnOrName) -> Column:
    return _col(v).cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def same_length(a: ColumnOrName, b: ColumnOrName) -> tuple[Column, Column]:
    """Both vectors cut to the shorter one's length, as doubles."""
    a, b = doubles(a), doubles(b)
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def l2sq(a: ColumnOrName, b: ColumnOrName, dim: int | None = None) -> Column:
    """Squared L2 distance in double precision; null where either vector is null.

    With ``dim`` known (both sides have just so many components) the sum is written out term by term, which
    Catalyst compiles into one generated function; otherwise it is a fold over the zipped arrays.
    """
    a, b = doubles(a), doubles(b)
    if dim is None:
        return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    total = F.lit(0.0)
    for i in range(dim):
        d = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
        total = total + d * d
    return total


def l2(a: ColumnOrName, b: ColumnOrName) -> Column:
    """L2 distance over the shorter length."""
    return F.sqrt(l2sq(*same_length(a, b)))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 - cosine similarity over the shorter length; 1 where a norm is 0."""
    a, b = same_length(a, b)
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - dot(a, b) / (na * nb))


def distance(metric: str, a: ColumnOrName, b: ColumnOrName) -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return l2(a, b) if metric == "l2" else cosine(a, b)


def usable(v: ColumnOrName, dim: int) -> Column:
    """True for a vector of exactly ``dim`` components, none null, NaN or infinite, not all zero; else false."""
    v = _col(v)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unsigned_zeros(v: ColumnOrName) -> Column:
    """The same vector with -0.0 as 0.0, as DuckDB's aggregates over lists return it."""
    return F.transform(_col(v), lambda x: x + F.lit(0.0).cast("float"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of vectors of ``dim`` components as a matrix, in its own precision if ``dtype`` is None; no nulls allowed."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = pc.list_flatten(column) if isinstance(column, pa.Array) else column
    values = flat.to_numpy(zero_copy_only=False)
    return (values if dtype is None else values.astype(dtype, copy=False)).reshape(-1, dim)


def whole(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
    """The rows of a batch whose list in column ``i`` holds no null component; the check is one look where none does."""
    column = batch.column(i)
    flat = pc.list_flatten(column)
    if not flat.null_count:
        return batch
    bad = pc.unique(pc.list_parent_indices(column).filter(pc.is_null(flat)))
    keep = np.ones(len(column), bool)
    keep[bad.to_numpy()] = False
    return batch.filter(pa.array(keep))


def lists(x: np.ndarray, kind=pa.float32()) -> pa.Array:
    """A matrix as an Arrow list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.reshape(-1), kind))


def squared_distances(a: np.ndarray, b: np.ndarray, bb: np.ndarray | None = None) -> np.ndarray:
    """All squared distances by one matrix product; exact only up to rounding of the products."""
    bb = np.einsum("ij,ij->i", b, b) if bb is None else bb
    d = a @ b.T
    d *= -2
    d += np.einsum("ij,ij->i", a, a)[:, None]
    d += bb[None, :]
    return np.maximum(d, 0, out=d)
