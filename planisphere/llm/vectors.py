"""Vectors that take part in a comparison, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, embedding`` of the rows that can be compared.

    Left out: rows with a null id, null and empty vectors, vectors of zero length or with a null
    or non-finite entry, and vectors with another number of entries than most have (ties: the fewer).
    """
    v = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    v = v.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad)).filter(F.exists("embedding", lambda x: x != 0))
    most = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.filter(F.size("embedding") == (most.d if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def near_one(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest entry near one: no square is lost or overflows, no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = near_one(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] if len(x) else x


def sample(df: DataFrame, rows: int, seed: int = 42) -> np.ndarray:
    """At most ``rows`` unit vectors in the order of a seeded hash of the id: bounded by the parameter."""
    some = df.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(rows).select("embedding").collect()
    return unit(np.array([r.embedding for r in some], np.float64)) if some else np.empty((0, 1))


def by_key(batches, keys: int):
    """Arrow batches sorted by their first ``keys`` columns, cut where these change; yields (key, batch)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        for s, e in zip(at, [*at[1:], batch.num_rows]):
            yield tuple(int(c[s]) for c in cols), batch.slice(s, e - s)
