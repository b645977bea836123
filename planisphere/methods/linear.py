"""Projections that need only moments of the data, plus one pass to place the rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.functions.seeded import normal_matrix, u01_value
from planisphere.functions.vectors import as_xy, map_matrix, to_matrix, vector_dim
from planisphere.operators.moments import Moments, minmax_shift, moments, sum_arrays
from planisphere.operators.tall import count_and_mean, range_svd
from planisphere.registry import method

WIDE = 4096


@dataclass(frozen=True)
class LinearMap:
    """coords = (x - mean) . loadings^T with k x d loadings."""

    mean: np.ndarray
    loadings: np.ndarray
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.loadings.T


def place(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """item_id, group_key, x, y from a matrix-to-matrix function."""
    return as_xy(map_matrix(df.select("item_id", "group_key", "embedding"), "embedding", fn))


def project(df: DataFrame, model: LinearMap, out: str = "embedding") -> DataFrame:
    """The vectors replaced by their coordinates under the model."""
    return map_matrix(df, "embedding", model.apply, out=out)


def fix_signs(rows: np.ndarray) -> np.ndarray:
    """Each row with its largest absolute entry positive."""
    at = np.argmax(np.abs(rows), axis=1)
    sign = np.sign(rows[np.arange(len(rows)), at])
    return rows * np.where(sign == 0, 1.0, sign)[:, None]


def top_eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest k eigenvalues and their vectors as sign-fixed rows."""
    values, vectors = np.linalg.eigh((a + a.T) / 2.0)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], fix_signs(vectors[:, order].T)


def solver_of(df: DataFrame, solver: str) -> str:
    """``exact`` needs d x d memory, ``tsqr`` d x l; ``auto`` is exact up to ``WIDE`` dimensions."""
    if solver not in ("auto", "exact", "tsqr"):
        raise ValueError(f"unknown solver {solver!r}; known: auto, exact, tsqr")
    if solver == "auto":
        return "tsqr" if vector_dim(df.limit(1)) > WIDE else "exact"
    return solver


def principal(df: DataFrame, k: int, solver: str = "auto", centred: bool = True, ddof: int = 1, seed: int = 42) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, mean, and the k largest eigenvalues and axes of the covariance, or uncentred of the sum of outer products."""
    if solver_of(df, solver) == "exact":
        m = moments(df)
        values, axes = top_eigen(m.covariance(ddof) if centred else m.gram, k)
        return m.n, m.mean if centred else np.zeros(m.dim), values, axes
    n, mean = count_and_mean(df)
    mean = mean if centred else np.zeros(len(mean))
    values, axes = range_svd(df, k, mean, seed=seed)
    return n, mean, values**2 / (max(n - ddof, 1) if centred else 1), fix_signs(axes)


def fit_pca(df: DataFrame, k: int = 2, stats: Moments | None = None, seed: int = 42, solver: str = "auto") -> LinearMap:
    """Principal axes from the covariance, or from a range finder where d x d is too large."""
    if stats is not None:
        values, axes = top_eigen(stats.covariance(), k)
        return LinearMap(stats.mean, axes, values)
    _, mean, values, axes = principal(df, k, solver, seed=seed)
    return LinearMap(mean, axes, values)


@method("pca")
def pca(df: DataFrame, params: dict) -> DataFrame:
    return place(df, fit_pca(df, params["n_components"], seed=params["random_state"], solver=params["solver"]).apply)


@method("ipca")
def ipca(df: DataFrame, params: dict) -> DataFrame:
    """Batches of ``batch_size`` rows merge exactly, so the result equals PCA of all rows."""
    m = moments(df, batch_rows=params["batch_size"])
    return place(df, fit_pca(df, params["n_components"], stats=m).apply)


def fit_svd(df: DataFrame, k: int = 2, solver: str = "auto", seed: int = 42) -> LinearMap:
    _, origin, values, axes = principal(df, k, solver, centred=False, seed=seed)
    return LinearMap(origin, axes, np.sqrt(np.maximum(values, 0.0)))


@method("svd")
def svd(df: DataFrame, params: dict) -> DataFrame:
    return place(df, fit_svd(df, params["n_components"], params["solver"], params["random_state"]).apply)


# --- factor analysis

@dataclass(frozen=True)
class Factors:
    mean: np.ndarray
    loadings: np.ndarray
    noise: np.ndarray
    likelihood: list[float]

    def apply(self, x: np.ndarray) -> np.ndarray:
        scaled = self.loadings / self.noise[:, None]
        inner = np.linalg.inv(np.eye(self.loadings.shape[1]) + self.loadings.T @ scaled)
        return (x - self.mean) @ scaled @ inner


def fit_fa(df: DataFrame, k: int = 2, max_iter: int = 1000, tol: float = 1e-8, solver: str = "auto") -> Factors:
    """EM for x = mean + W z + noise with a diagonal noise covariance.

    It needs the diagonal of the covariance and its product with d x k matrices: from the covariance itself, or, where
    that is too large, from one pass over the rows per round.
    """
    exact = solver_of(df, solver) == "exact"
    if exact:
        m = moments(df)
        n, mean, s = m.n, m.mean, m.covariance(ddof=0)
        diagonal = np.diag(s)
        values, axes = top_eigen(s, k)
    else:
        n, mean, values, axes = principal(df, k, "tsqr", ddof=0)
        diagonal = sum_arrays(df.select("embedding"), lambda b: [((to_matrix(b.column(0)) - mean) ** 2).sum(axis=0)])[0] / n

    def times(a):
        """The covariance times a d x k matrix."""
        if exact:
            return s @ a

        def part(batch):
            x = to_matrix(batch.column(0)) - mean
            return [x.T @ (x @ a)]

        return sum_arrays(df.select("embedding"), part)[0] / n

    d = len(mean)
    noise = np.maximum(diagonal, 1e-12)
    w = (axes * np.sqrt(np.maximum(values, 1e-12))[:, None]).T
    history: list[float] = []
    for _ in range(max_iter):
        # Woodbury: only k x k systems are inverted.
        scaled = w / noise[:, None]
        core = np.eye(k) + w.T @ scaled
        beta = np.linalg.solve(core, scaled.T)
        logdet = np.log(noise).sum() + np.linalg.slogdet(core)[1]
        image = times(scaled)  # beta is the inverse of the core times scaled', so one product serves both
        fit = (diagonal / noise).sum() - np.trace(beta @ image)
        history.append(-0.5 * n * (d * math.log(2 * math.pi) + logdet + fit))
        if len(history) > 1 and abs(history[-1] - history[-2]) < tol * abs(history[-2]):
            break
        sb = image @ np.linalg.inv(core)
        w = sb @ np.linalg.inv(np.eye(k) - beta @ w + beta @ sb)
        noise = np.maximum(diagonal - np.einsum("ij,ij->i", w, sb), 1e-12)
    return Factors(mean, fix_signs(w.T).T, noise, history)


@method("fa")
def fa(df: DataFrame, params: dict) -> DataFrame:
    return place(df, fit_fa(df, params["n_components"], solver=params["solver"]).apply)


# --- independent components

def fit_ica(df: DataFrame, k: int = 2, max_iter: int = 500, tol: float = 1e-4, seed: int = 42, solver: str = "auto") -> LinearMap:
    """Symmetric fixed-point iteration with the logcosh contrast on whitened rows.

    The whitened table has k numbers per row and is kept; each round is one
    aggregate of k * (k + 1) expressions over it.
    """
    _, mean, values, axes = principal(df, k, solver, ddof=0, seed=seed)
    white = LinearMap(mean, axes / np.sqrt(np.maximum(values, 1e-12))[:, None], values)
    z = map_matrix(df.select("embedding"), "embedding", white.apply, out="z").select(
        *[F.col("z")[i].alias(f"z{i}") for i in range(k)]).persist()

    def decorrelate(a):
        u, _, vt = np.linalg.svd(a)
        return u @ vt

    w = decorrelate(normal_matrix(f"{seed}:ica", k, k))
    try:
        for _ in range(max_iter):
            cells = []
            for a in range(k):
                u = sum((F.lit(float(w[a, i])) * F.col(f"z{i}") for i in range(k)), F.lit(0.0))
                g = F.tanh(u)
                cells += [F.avg(g * F.col(f"z{i}")).alias(f"m{a}_{i}") for i in range(k)]
                cells.append(F.avg(F.lit(1.0) - g * g).alias(f"d{a}"))
            row = z.agg(*cells).first()
            new = decorrelate(np.array([[row[f"m{a}_{i}"] - row[f"d{a}"] * w[a, i] for i in range(k)] for a in range(k)]))
            change = np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1.0))
            w = new
            if change < tol:
                break
    finally:
        z.unpersist()
    return LinearMap(mean, w @ white.loadings, values)


@method("ica")
def ica(df: DataFrame, params: dict) -> DataFrame:
    model = fit_ica(df, params["n_components"], params["max_iter"], seed=params["random_state"], solver=params["solver"])
    return place(df, model.apply)


# --- factorisations whose row part follows from the small part

def _nonnegative(v: np.ndarray, h: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Rows w >= 0 minimising |v - w h|^2 by coordinate descent."""
    g, b = h @ h.T, v @ h.T
    w = np.maximum(b / np.maximum(g.sum(axis=1), 1e-12), 0.0)
    for _ in range(sweeps):
        old = w.copy()
        for a in range(len(h)):
            if g[a, a] > 0:
                w[:, a] = np.maximum(w[:, a] + (b[:, a] - w @ g[:, a]) / g[a, a], 0.0)
        if len(w) == 0 or np.max(np.abs(w - old)) < 1e-12:
            break
    return w


@dataclass(frozen=True)
class Parts:
    atoms: np.ndarray
    objective: list[float]
    code: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.code(x, self.atoms)


def _nonnegative_start(svd_model: LinearMap, average: float, init: str) -> np.ndarray:
    """Per singular triplet the larger of its positive and negative part."""
    h = np.zeros_like(svd_model.loadings)
    for a, (v, s) in enumerate(zip(svd_model.loadings, svd_model.values, strict=True)):
        positive, negative = np.maximum(v, 0.0), np.maximum(-v, 0.0)
        part = positive if np.linalg.norm(positive) >= np.linalg.norm(negative) else negative
        h[a] = math.sqrt(max(s, 0.0)) * part
    if init == "nndsvda":
        h[h == 0] = average
    return h


def fit_nmf(df: DataFrame, k: int = 2, init: str = "nndsvda", max_iter: int = 200, tol: float = 1e-4) -> Parts:
    """Alternating least squares with non-negative parts; ``df`` must be non-negative.

    Row weights are recomputed from the k x d part, so a round is one pass with
    one small aggregate and keeps no state between rounds.
    """
    m = moments(df)
    values, axes = top_eigen(m.gram, k)
    svd_model = LinearMap(np.zeros(m.dim), axes, np.sqrt(np.maximum(values, 0.0)) / math.sqrt(max(m.n, 1)))
    h = _nonnegative_start(svd_model, float(m.mean.mean()), init)
    history: list[float] = []
    for _ in range(max_iter):
        def part(batch, h=h):
            v = to_matrix(batch.column(0))
            w = _nonnegative(v, h)
            return [w.T @ w, w.T @ v, np.array(((v - w @ h) ** 2).sum())]

        ww, wv, err = sum_arrays(df.select("embedding"), part)
        history.append(0.5 * float(err))
        if len(history) > 1 and history[-2] - history[-1] <= tol * max(history[0], 1e-12):
            break
        h = h.copy()
        for _ in range(10):
            for a in range(k):
                if ww[a, a] > 0:
                    h[a] = np.maximum(h[a] + (wv[a] - ww[a] @ h) / ww[a, a], 0.0)
    return Parts(h, history, _nonnegative)


@method("nmf")
def nmf(df: DataFrame, params: dict) -> DataFrame:
    shifted = minmax_shift(df)
    return place(shifted, fit_nmf(shifted, params["n_components"], params["init"]).apply)


def lasso_code(alpha: float, sweeps: int = 200) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Codes c minimising 1/2 |x - c D|^2 + alpha |c|_1 by coordinate descent."""

    def code(x: np.ndarray, atoms: np.ndarray) -> np.ndarray:
        g, b = atoms @ atoms.T, x @ atoms.T
        c = np.zeros((len(x), len(atoms)))
        for _ in range(sweeps):
            old = c.copy()
            for a in range(len(atoms)):
                if g[a, a] > 0:
                    r = b[:, a] - c @ g[:, a] + c[:, a] * g[a, a]
                    c[:, a] = np.sign(r) * np.maximum(np.abs(r) - alpha, 0.0) / g[a, a]
            if len(c) == 0 or np.max(np.abs(c - old)) < 1e-12:
                break
        return c

    return code


def fit_dictionary(df: DataFrame, k: int = 2, alpha: float = 1.0, max_iter: int = 100, tol: float = 1e-8) -> Parts:
    """Sparse codes and atoms in the unit ball, alternating; one aggregate per round."""
    m = moments(df)
    _, atoms = top_eigen(m.gram, k)
    code = lasso_code(alpha)
    history: list[float] = []
    for _ in range(max_iter):
        def part(batch, atoms=atoms):
            x = to_matrix(batch.column(0))
            c = code(x, atoms)
            return [c.T @ c, c.T @ x, np.array(0.5 * ((x - c @ atoms) ** 2).sum() + alpha * np.abs(c).sum())]

        cc, cx, loss = sum_arrays(df.select("embedding"), part)
        history.append(float(loss))
        if len(history) > 1 and history[-2] - history[-1] <= tol * max(history[0], 1e-12):
            break
        atoms = atoms.copy()
        for _ in range(10):
            for a in range(k):
                if cc[a, a] > 1e-12:
                    atoms[a] += (cx[a] - cc[a] @ atoms) / cc[a, a]
                    atoms[a] /= max(np.linalg.norm(atoms[a]), 1.0)
    return Parts(atoms, history, code)


@method("dictlearn")
def dictlearn(df: DataFrame, params: dict) -> DataFrame:
    model = fit_dictionary(df, params["n_components"], params.get("alpha", 1.0))
    return place(df, model.apply)


# --- random projections

def gaussian_matrix(seed, d: int, k: int) -> np.ndarray:
    """d x k entries of variance 1/k."""
    return normal_matrix(seed, d, k) / math.sqrt(k)


def sparse_matrix(seed, d: int, k: int, density: float | None = None) -> np.ndarray:
    """d x k entries +-sqrt(1 / (density * k)) with probability density / 2 each, else 0."""
    share = 1.0 / math.sqrt(d) if density is None else density
    size = math.sqrt(1.0 / (share * k))
    u = np.array([[u01_value(seed, r, c) for c in range(k)] for r in range(d)])
    return np.where(u < share / 2, size, np.where(u >= 1 - share / 2, -size, 0.0))


@method("grp")
def grp(df: DataFrame, params: dict) -> DataFrame:
    r = gaussian_matrix(params["random_state"], vector_dim(df.limit(1)), params["n_components"])
    return place(df, lambda x: x @ r)


@method("srp")
def srp(df: DataFrame, params: dict) -> DataFrame:
    density = None if params["density"] in (None, "auto") else float(params["density"])
    r = sparse_matrix(params["random_state"], vector_dim(df.limit(1)), params["n_components"], density)
    return place(df, lambda x: x @ r)


# --- feature agglomeration

def ward_columns(sq: np.ndarray, clusters: int) -> np.ndarray:
    """Cluster of every column by Ward merging of squared distances; clusters in order of first column."""
    d = len(sq)
    dist = sq.astype(float).copy()
    np.fill_diagonal(dist, np.inf)
    size = np.ones(d)
    members = {i: [i] for i in range(d)}
    for _ in range(max(d - clusters, 0)):
        i, j = sorted(np.unravel_index(np.argmin(dist), dist.shape))
        rest = np.array([c for c in members if c not in (i, j)], dtype=int)
        t = size[i] + size[j] + size[rest]
        joined = ((size[i] + size[rest]) * dist[i, rest] + (size[j] + size[rest]) * dist[j, rest] - size[rest] * dist[i, j]) / t
        dist[i, rest] = dist[rest, i] = joined
        dist[j, :] = dist[:, j] = np.inf
        members[i] += members.pop(j)
        size[i] += size[j]
    out = np.zeros(d, dtype=int)
    for c, first in enumerate(sorted(members, key=lambda i: min(members[i]))):
        out[members[first]] = c
    return out


def fit_agg(df: DataFrame, clusters: int = 2) -> np.ndarray:
    g = moments(df).gram
    sq = np.maximum(np.diag(g)[:, None] + np.diag(g)[None, :] - 2.0 * g, 0.0)
    return ward_columns(sq, clusters)


@method("agg")
def agg(df: DataFrame, params: dict) -> DataFrame:
    cluster = fit_agg(df, params["n_clusters"])
    pick = np.stack([(cluster == c) / (cluster == c).sum() for c in range(cluster.max() + 1)], axis=1)
    return place(df, lambda x: x @ pick)


# --- kernels on landmarks

def kernel(name: str, gamma: float | None, degree: float = 3.0, shift: float = 1.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def rbf(x, marks, g):
        sq = (x * x).sum(axis=1)[:, None] + (marks * marks).sum(axis=1)[None, :] - 2.0 * (x @ marks.T)
        return np.exp(-g * np.maximum(sq, 0.0))

    kinds = {
        "linear": lambda x, m, g: x @ m.T,
        "rbf": rbf,
        "poly": lambda x, m, g: (g * (x @ m.T) + shift) ** degree,
        "sigmoid": lambda x, m, g: np.tanh(g * (x @ m.T) + shift),
        "cosine": lambda x, m, g: (x @ m.T) / np.maximum(
            np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :], 1e-12),
    }
    if name not in kinds:
        raise ValueError(f"unknown kernel {name!r}; known: {', '.join(kinds)}")
    return lambda x, m: kinds[name](x, m, 1.0 / x.shape[1] if gamma is None else gamma)


def landmark_matrix(df: DataFrame, count: int, seed) -> np.ndarray:
    """``count`` seeded landmark vectors: count x d, a size set by parameters."""
    from planisphere.operators.subset import landmarks_random

    return np.array([r[0] for r in landmarks_random(df, "item_id", count, seed).select("embedding").collect()], dtype=float)


def fit_kernel_pca(df: DataFrame, k: int, name: str, gamma: float | None, landmarks: int, seed) -> Callable:
    """Centred PCA of the kernel features K(x, L) K_LL^(-1/2); exact when every row is a landmark."""
    marks = landmark_matrix(df, landmarks, seed)
    kern = kernel(name, gamma)
    values, vectors = np.linalg.eigh(kern(marks, marks))
    # Directions without weight carry no information; the floor keeps the root finite.
    ok = values > 1e-12 * max(values.max(), 1e-300)
    root = (vectors[:, ok] / np.sqrt(values[ok])) @ vectors[:, ok].T

    def features(x):
        return kern(x, marks) @ root

    model = fit_pca(df, k, stats=moments(map_matrix(df.select("embedding"), "embedding", features, out="embedding")))
    return lambda x: model.apply(features(x))


@method("kpca")
def kpca(df: DataFrame, params: dict) -> DataFrame:
    count = params.get("landmarks", 1024)
    return place(df, fit_kernel_pca(df, params["n_components"], params["kernel"], params["gamma"], count, params["random_state"]))


@method("nystroem_pca")
def nystroem_pca(df: DataFrame, params: dict) -> DataFrame:
    return place(df, fit_kernel_pca(df, params["n_components"], params["kernel"], params["gamma"],
                                    params["nystroem_components"], params["random_state"]))
