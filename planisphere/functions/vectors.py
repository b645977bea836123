"""Vector expressions on array columns and Arrow <-> numpy conversion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "manhattan", "minkowski")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    """Distance of two double arrays; a zero vector is at cosine distance 1 from everything."""
    if metric == "euclidean":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "manhattan":
        return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric == "minkowski":
        return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))
    if metric == "cosine":
        scale = norm(a) * norm(b)
        return F.when(scale > 0, 1.0 - dot(a, b) / scale).otherwise(F.lit(1.0))
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def l2_normalise(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    length = norm(v)
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x))


def is_valid(v: Column, dim: int | None = None) -> Column:
    """No null vector, no null, NaN or infinite cell, and the given length."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & ~bad
    return ok & (F.size(v) == dim) if dim is not None else ok


def to_matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Rows of a list column as a dense float64 matrix; unequal lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n == 0:
        return np.zeros((0, dim or 0))
    if column.null_count or flat.size % n:
        raise ValueError("vectors are null or differ in length")
    width = flat.size // n
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any() or (dim is not None and width != dim):
        raise ValueError("vectors differ in length")
    return flat.reshape(n, width)


def to_lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list<double> array."""
    n, d = matrix.shape
    flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float64).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), flat)


def map_matrix(df: DataFrame, vec: str, fn: Callable[[np.ndarray], np.ndarray], out: str = "coords",
               keep: list[str] | None = None) -> DataFrame:
    """Apply a matrix-to-matrix function batch by batch; other columns pass through."""
    keep = keep if keep is not None else [c for c in df.columns if c != vec]

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            result = fn(to_matrix(batch.column(batch.num_columns - 1)))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [to_lists(result)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, out])

    source = df.select(*keep, vec)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*fields, f"`{out}` array<double>"]))


def as_xy(df: DataFrame, coords: str = "coords") -> DataFrame:
    """Replace a coordinate array by its first two entries as x and y."""
    keep = [c for c in df.columns if c != coords]
    return df.select(*keep, F.col(coords)[0].alias("x"), F.col(coords)[1].alias("y"))


def vector_dim(df: DataFrame, vec: str = "embedding") -> int:
    """Common length of the vectors: one aggregate, an error if they differ."""
    row = df.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
    if row.lo is None:
        raise ValueError("no vectors")
    if row.lo != row.hi:
        raise ValueError(f"vectors differ in length: {row.lo} to {row.hi}")
    return int(row.lo)
