"""Singular vectors of tall tables with d x l memory: a range finder on a tree of QR factorisations.

Rows times a d x l basis are a tall and narrow matrix. Its triangular factor comes from
factors of batches, stacked and factored again up a tree, so it is as exact as one
factorisation of all rows and no product of the matrix with itself is formed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from planisphere.functions.seeded import normal_matrix
from planisphere.functions.vectors import to_matrix, vector_dim
from planisphere.operators.moments import fold_arrays, sum_arrays


def triangle(x: np.ndarray) -> np.ndarray:
    """The square triangular factor of a matrix, with zero rows where it has fewer rows than columns."""
    r = np.linalg.qr(x, mode="r")
    return np.vstack([r, np.zeros((x.shape[1] - len(r), x.shape[1]))])


def qr_and_sum(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [triangle(np.vstack([a[0], b[0]])), a[1] + b[1]]


def count_and_mean(df: DataFrame) -> tuple[int, np.ndarray]:
    n, total = sum_arrays(df.select("embedding"), lambda b: [np.array(float(b.num_rows)), to_matrix(b.column(0)).sum(axis=0)])
    return int(n), total / n


def range_svd(df: DataFrame, k: int, mean: np.ndarray | None = None, oversample: int = 16, passes: int = 12, tol: float = 1e-10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of the rows less ``mean`` and their right vectors as rows.

    A pass multiplies the rows by the basis of the pass before, factors the product, and turns the basis towards the
    leading vectors; passes end when the values stand still.
    """
    d = vector_dim(df.limit(1))
    shift = np.zeros(d) if mean is None else mean
    basis = np.linalg.qr(normal_matrix(seed, d, min(k + oversample, d)))[0]
    before = np.zeros(k)
    for _ in range(passes):
        def part(batch, basis=basis):
            x = to_matrix(batch.column(0)) - shift
            y = x @ basis
            return [triangle(y), y.T @ x]

        r, image = fold_arrays(df.select("embedding"), part, qr_and_sum)
        # With y = q r the rows in the range are q (q' x), and q' x is r'^-1 (y' x).
        _, values, vectors = np.linalg.svd(np.linalg.lstsq(r.T, image, rcond=1e-13)[0], full_matrices=False)
        basis = np.linalg.qr(vectors.T)[0]
        if np.abs(values[:k] - before[: len(values[:k])]).max() <= tol * max(values[0], 1e-300):
            break
        before = values[:k]
    return values[:k], vectors[:k]
