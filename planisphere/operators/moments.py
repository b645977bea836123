"""Mean and scatter of a vector column in one pass, and scaling built on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.functions.vectors import l2_normalise, map_matrix, to_matrix

_PARTIAL = "blk int, salt int, n bigint, mean binary, part binary"
_BLOCK_BYTES = 128 * 1024
_SALTS = 16


@dataclass(frozen=True)
class Moments:
    """Count, mean and centred scatter matrix; d x d, so bounded by the dimension."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.mean)

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.scatter / max(self.n - ddof, 1)

    @property
    def gram(self) -> np.ndarray:
        """Uncentred sum of outer products."""
        return self.scatter + self.n * np.outer(self.mean, self.mean)

    def merge(self, other: Moments) -> Moments:
        """Moments of the union of two disjoint row sets."""
        if self.n == 0:
            return other
        if other.n == 0:
            return self
        n = self.n + other.n
        delta = other.mean - self.mean
        return Moments(
            n, self.mean + delta * (other.n / n),
            self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n),
        )


def moments_of(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    centred = x - mean
    return Moments(len(x), mean, centred.T @ centred)


def _rows(parts, salt: int) -> pa.RecordBatch:
    cols = list(zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array(cols[1], pa.int64()),
         pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
        names=["blk", "salt", "n", "mean", "part"],
    )


def _partials(batch_rows: int | None):
    def run(batches):
        import pyspark

        context = pyspark.TaskContext.get()
        salt = (context.partitionId() if context else 0) % _SALTS
        total = None
        for batch in batches:
            step = batch_rows or max(batch.num_rows, 1)
            for start in range(0, batch.num_rows, step):
                m = moments_of(to_matrix(batch.column(0).slice(start, step)))
                total = m if total is None else total.merge(m)
        if total is None:
            return
        step = max(_BLOCK_BYTES // (8 * total.dim), 1)
        mean = total.mean.tobytes()
        yield _rows(
            [(b, total.n, mean, total.scatter[r:r + step].tobytes()) for b, r in enumerate(range(0, total.dim, step))], salt
        )

    return run


def _merge_blocks(batches):
    """Merge partials of the same block of scatter rows."""
    state: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for blk, n, mean, part in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            mb = np.frombuffer(mean)
            pb = np.frombuffer(part).reshape(-1, len(mb))
            if blk not in state:
                state[blk] = (n, mb, pb)
                continue
            na, ma, pa_ = state[blk]
            step = max(_BLOCK_BYTES // (8 * len(mb)), 1)
            delta = mb - ma
            mine = delta[blk * step: blk * step + len(pb)]
            t = na + n
            state[blk] = (t, ma + delta * (n / t), pa_ + pb + np.outer(mine, delta) * (na * n / t))
    if state:
        yield _rows([(b, n, m.tobytes(), p.tobytes()) for b, (n, m, p) in sorted(state.items())], 0)


def moments(df: DataFrame, vec: str = "embedding", batch_rows: int | None = None) -> Moments:
    """One pass over the vectors; partial results merge in a tree keyed by blocks of matrix rows.

    Only the final d x d result reaches the driver. ``batch_rows`` bounds the rows
    merged at a time within a task.
    """
    parts = df.select(vec).mapInArrow(_partials(batch_rows), _PARTIAL)
    level = parts.repartition(F.col("blk"), F.col("salt")).mapInArrow(_merge_blocks, _PARTIAL)
    rows = level.repartition(F.col("blk")).mapInArrow(_merge_blocks, _PARTIAL).collect()
    rows.sort(key=lambda r: r["blk"])
    if not rows:
        raise ValueError("no vectors")
    mean = np.frombuffer(rows[0]["mean"])
    scatter = np.concatenate([np.frombuffer(r["part"]).reshape(-1, len(mean)) for r in rows])
    return Moments(rows[0]["n"], mean.copy(), scatter)


def sum_arrays(df: DataFrame, fn: Callable[[pa.RecordBatch], list[np.ndarray]]) -> list[np.ndarray]:
    """Element-wise sum, over all batches of ``df``, of arrays whose size depends on parameters only."""
    return fold_arrays(df, fn, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])


def fold_arrays(df: DataFrame, fn: Callable[[pa.RecordBatch], list[np.ndarray]], both: Callable) -> list[np.ndarray]:
    """``both``, an associative function of two lists of arrays, over what ``fn`` makes of all batches.

    Every task sends one partial, at most ``_SALTS`` merged partials reach the driver.
    """

    def add(total, new):
        return new if total is None else both(total, new)

    def row(arrays, salt):
        shapes = [list(a.shape) for a in arrays]
        data = [np.ascontiguousarray(a, dtype=np.float64).tobytes() for a in arrays]
        return pa.RecordBatch.from_arrays(
            [pa.array([salt], pa.int32()), pa.array([shapes], pa.list_(pa.list_(pa.int32()))),
             pa.array([data], pa.list_(pa.binary()))], names=["salt", "shapes", "parts"])

    def unpack(shapes, parts):
        return [np.frombuffer(p).reshape(s) for s, p in zip(shapes, parts, strict=True)]

    def partial(batches):
        import pyspark

        context = pyspark.TaskContext.get()
        total = None
        for batch in batches:
            if batch.num_rows:
                total = add(total, [np.asarray(a, dtype=np.float64) for a in fn(batch)])
        if total is not None:
            yield row(total, (context.partitionId() if context else 0) % _SALTS)

    def merge(batches):
        total = None
        for batch in batches:
            for shapes, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total = add(total, unpack(shapes, parts))
        if total is not None:
            yield row(total, 0)

    schema = "salt int, shapes array<array<int>>, parts array<binary>"
    level = df.mapInArrow(partial, schema).repartition(F.col("salt")).mapInArrow(merge, schema)
    total = None
    for r in level.collect():
        total = add(total, unpack(r["shapes"], r["parts"]))
    if total is None:
        raise ValueError("no rows")
    return total


def covariance_table(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Covariance as (i, j, cov) with one-based columns."""
    m = moments(df, vec)
    c = m.covariance()
    cells = [(i + 1, j + 1, float(c[i, j])) for i in range(m.dim) for j in range(m.dim)]
    return df.sparkSession.createDataFrame(cells, "i int, j int, cov double")


def standardise(df: DataFrame, vec: str = "embedding", ddof: int = 0, stats: Moments | None = None) -> DataFrame:
    """Zero mean and unit deviation per column; a constant column is only centred."""
    m = stats or moments(df, vec)
    sd = np.sqrt(np.diag(m.scatter) / max(m.n - ddof, 1))
    scale = np.where(sd > 0, sd, 1.0)
    mean = m.mean
    return map_matrix(df, vec, lambda x: (x - mean) / scale, out=vec)


def normalise_rows(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Unit Euclidean length per row."""
    return df.withColumn(vec, l2_normalise(F.col(vec)))


def minmax_shift(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Every cell minus the smallest cell of the table, if that is negative."""
    low = df.agg(F.min(F.array_min(vec)).alias("m")).select(F.least(F.col("m"), F.lit(0.0))).scalar()
    return df.select(*[c for c in df.columns if c != vec], low.alias("_low"), vec).select(
        *[c for c in df.columns if c != vec], F.transform(F.col(vec), lambda x: x - F.col("_low")).alias(vec)
    )
