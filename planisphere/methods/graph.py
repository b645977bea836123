"""Embeddings of neighbour graphs: geodesic, spectral, local-linear and diffusion maps."""

from __future__ import annotations

import math
import warnings
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.functions.seeded import normal_value
from planisphere.functions.vectors import as_xy, map_matrix
from planisphere.methods.stress import classical_mds, smacof
from planisphere.operators.graph import (
    EXTRA_VECTORS, Eigen, Links, Neighbours, barycentre_weights, connect, eigenvectors, geodesics, neighbours, product,
)
from planisphere.operators.knn import knn_exact, symmetrise
from planisphere.operators.moments import sum_arrays
from planisphere.operators.one_task import times
from planisphere.operators.subset import landmarks_random
from planisphere.registry import method, neighbour_options
from planisphere.session import cut


def oriented(vectors: DataFrame, k: int, scale: float = 1.0) -> DataFrame:
    """node, x, y: every axis with its largest absolute entry positive."""
    peaks = vectors.agg(*[F.max_by(f"v{i}", F.abs(f"v{i}")).alias(f"p{i}") for i in range(k)]).first()
    signs = [-1.0 if (p or 0.0) < 0 else 1.0 for p in peaks]
    return vectors.select("node", *[(F.col(f"v{i}") * F.lit(signs[i] * scale)).alias(c) for i, c in zip(range(k), "xy", strict=False)])


def warn_open(found: Eigen, tol: float, name: str) -> Eigen:
    """Say so when the eigenpairs did not reach the tolerance within the allowed products."""
    if not found.converged(tol):
        warnings.warn(f"{name}: eigenvector residuals {found.residuals.tolist()} exceed {tol}; raise max_iter", stacklevel=2)
    return found


# --- isometric maps

def undirected(nb: Neighbours) -> DataFrame:
    return cut(symmetrise(nb.knn.select("src", "dst", F.col("dist").alias("w")), "min"))


@method("isomap")
def isomap(df: DataFrame, params: dict) -> DataFrame:
    """Landmark form: paths from L sources, classical scaling of L x L, then each row by itself."""
    nb = neighbours(df, params["n_neighbors"], params["backend"], **neighbour_options(params))
    edges = undirected(nb)
    if params["on_disconnected"] == "join":
        edges = connect(nb, edges)
    marks = [r[0] for r in landmarks_random(nb.nodes.select("node"), "node", params["landmarks"], params["random_state"]).collect()]
    marks.sort()
    links = Links(edges, nb.n, 16 + 16 * len(marks))
    paths = geodesics(links, marks)
    links.close()
    rows = cut(paths.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("mark", "dist"))).alias("p"))
               .select("node", F.col("p.dist").alias("embedding")))
    if rows.filter(F.size("embedding") < len(marks)).limit(1).count() or rows.count() < nb.n:
        raise ValueError("the neighbour graph is not connected; use on_disconnected='join' or more neighbours")
    at = {r["node"]: r["embedding"] for r in rows.filter(F.col("node").isin(marks)).collect()}
    sq = np.array([at[m] for m in marks]) ** 2
    placed, solve = classical_mds((sq + sq.T) / 2, params["n_components"])
    return nb.back(as_xy(map_matrix(rows, "embedding", lambda d: solve(d * d))))


# --- spectral maps

def spectral_vectors(nb: Neighbours, edges: DataFrame, k: int, max_iter: int, tol: float, seed: int) -> tuple[Eigen, DataFrame]:
    """Leading non-trivial eigenvectors of the normalised adjacency; edges in both directions."""
    degrees = cut(edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg")))
    raw = Links(edges, nb.n, 16)
    both = raw.attach(raw.attach(raw.edges, "src", degrees, {"deg": "ds"}), "dst", degrees, {"deg": "dd"})
    scaled = both.select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))
    links = Links(scaled, nb.n, 16 + 8 * (k + EXTRA_VECTORS))
    raw.close()
    known = nb.nodes.select("node").join(degrees, "node", "left").select("node", F.sqrt(F.coalesce("deg", F.lit(0.0))).alias("u"))
    found = eigenvectors(nb.nodes.select("node"), lambda v, m: product(links, v, m), k, -1.0, 1.0, True, known,
                         max_iter=max_iter, tol=tol, seed=seed, links=links, here=lambda e, x: times(e["w"], x, e["dst"], e["src"]))
    links.close()
    return found, degrees


def fit_spectral(nb: Neighbours, params: dict) -> tuple[Eigen, DataFrame]:
    edges = cut(symmetrise(nb.knn.select("src", "dst", F.lit(1.0).alias("w")), "mean"))
    if params.get("on_disconnected", "join") == "join":
        edges = connect(nb, edges, close=F.lit(1.0))
    return spectral_vectors(nb, edges, params["n_components"], params["max_iter"], params["tol"], params["random_state"])


@method("spectral")
def spectral(df: DataFrame, params: dict) -> DataFrame:
    # The affinity counts the row itself among its neighbours.
    nb = neighbours(df, params["n_neighbors"] - 1, params["backend"], **neighbour_options(params))
    found, degrees = fit_spectral(nb, params)
    warn_open(found, params["tol"], "spectral")
    xy = oriented(found.vectors, params["n_components"])
    scaled = xy.join(degrees, "node").select("node", (F.col("x") / F.sqrt("deg")).alias("x"), (F.col("y") / F.sqrt("deg")).alias("y"))
    return nb.back(scaled)


# --- local linear maps

def bottom_vectors(nb: Neighbours, weights: DataFrame, k: int, max_iter: int, tol: float, seed: int) -> Eigen:
    """Bottom eigenvectors of (I - W)^T (I - W), the constant one left out."""
    links = Links(weights, nb.n, 16 + 8 * (k + EXTRA_VECTORS))
    out_norm = weights.groupBy("src").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).first()[0] or 0.0
    in_norm = weights.groupBy("dst").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).first()[0] or 0.0

    def half(values, m, frm, to, out):
        got = product(links, values, m, frm=frm, to=to)
        return values.join(got, "node", "left").selectExpr("node", *[f"v{i} - coalesce(a{i}, 0D) AS {out}{i}" for i in range(m)])

    def multiply(values, m):
        # The inner product is read twice, so it is written once.
        return half(cut(half(values, m, "dst", "src", "v")), m, "src", "dst", "a")

    def here(e, x):
        inner = x - times(e["w"], x, e["dst"], e["src"])
        return inner - times(e["w"], inner, e["src"], e["dst"])

    known = nb.nodes.select("node", F.lit(1.0).alias("u"))
    found = eigenvectors(nb.nodes.select("node"), multiply, k, 0.0, (1 + out_norm) * (1 + in_norm), False, known,
                         max_iter=max_iter, tol=tol, seed=seed, links=links, here=here)
    links.close()
    return found


def fit_lle(df: DataFrame, params: dict) -> tuple[DataFrame, DataFrame]:
    """item_id, group_key, node, x, y, and the weights src, dst, w that the map keeps."""
    nb = neighbours(df, params["n_neighbors"], params["backend"], **neighbour_options(params))
    return _linear_map(nb, cut(barycentre_weights(nb, params["reg"])), params, "lle")


def _linear_map(nb: Neighbours, weights: DataFrame, params: dict, name: str) -> tuple[DataFrame, DataFrame]:
    found = warn_open(bottom_vectors(nb, weights, params["n_components"], params["max_iter"], params["tol"], params["random_state"]), params["tol"], name)
    placed = nb.nodes.select("node", "item_id", "group_key").join(oriented(found.vectors, params["n_components"]), "node")
    return placed.select("item_id", "group_key", "node", "x", "y"), weights


@method("lle")
def lle(df: DataFrame, params: dict) -> DataFrame:
    return fit_lle(df, params)[0].drop("node")


def generative_solver(mode: str, reg: float, iterations: int, seed: int):
    """Weights as draws from their posterior, per row a k x k problem.

    The row given its weights is Gaussian around the rebuilt point with variance
    s2; the weights have a standard normal prior around 1/k. The expectation step
    gives their mean and covariance, the maximisation step the new s2. ``GLLE``
    iterates; ``GLLE_DirectSampling`` samples once around the regularised solution.
    """

    def solve(c, ids):
        n, k = c.shape[0], c.shape[1]
        trace = np.maximum(np.trace(c, axis1=1, axis2=2), 1e-300)
        eye = np.eye(k)
        plain = np.linalg.solve(c + (reg * trace)[:, None, None] * eye, np.ones((n, k, 1)))[:, :, 0]
        plain = plain / plain.sum(axis=1, keepdims=True)
        if mode == "GLLE":
            s2 = trace / k
            mean = plain
            for _ in range(iterations):
                precision = c / s2[:, None, None] + eye
                cov = np.linalg.inv(precision)
                mean = np.einsum("nab,b->na", cov, np.full(k, 1.0 / k))
                mean = mean / np.where(np.abs(mean.sum(axis=1, keepdims=True)) > 1e-12, mean.sum(axis=1, keepdims=True), 1.0)
                err = np.einsum("na,nab,nb->n", mean, c, mean) + np.einsum("nab,nba->n", c, cov)
                s2 = np.maximum(err / k, 1e-9 * trace)
        else:
            s2 = np.maximum(np.einsum("na,nab,nb->n", plain, c, plain), 1e-9 * trace)
            mean = plain
        root = np.linalg.cholesky(np.linalg.inv(c / s2[:, None, None] + k * k * eye))
        noise = np.array([[normal_value(seed, int(i), a) for a in range(k)] for i in ids])
        w = mean + np.einsum("nab,nb->na", root, noise) / k
        total = w.sum(axis=1, keepdims=True)
        return w / np.where(np.abs(total) > 1e-12, total, 1.0)

    return solve


def fit_glle(df: DataFrame, params: dict) -> tuple[DataFrame, DataFrame]:
    """item_id, group_key, node, x, y, and the drawn weights src, dst, w that the map keeps."""
    if params["n_components"] != 2:
        raise ValueError("glle places rows in two dimensions only")
    if params["method"] not in ("GLLE", "GLLE_DirectSampling"):
        raise ValueError(f"unknown glle method {params['method']!r}")
    nb = neighbours(df, params["k_neighbors"], params["backend"], **neighbour_options(params))
    solve = generative_solver(params["method"], params["reg"], params["max_iterations"], params["random_state"])
    return _linear_map(nb, cut(barycentre_weights(nb, params["reg"], solve)), params, "glle")


@method("glle")
def glle(df: DataFrame, params: dict) -> DataFrame:
    return fit_glle(df, params)[0].drop("node")


# --- diffusion maps

def decay_kernel(nb: Neighbours, knn: int, decay: float, floor: float = 1e-4) -> DataFrame:
    """src, dst, w: the symmetric alpha-decay kernel on the neighbour pairs, self pairs with weight 1."""
    width = nb.knn.filter(F.col("rank") == F.least(F.lit(knn), F.lit(nb.n - 1))).select(F.col("src").alias("node"), F.col("dist").alias("eps"))
    links = Links(symmetrise(nb.knn.select("src", "dst", F.col("dist").alias("w")), "min"), nb.n, 16)
    both = links.attach(links.attach(links.edges, "src", width, {"eps": "ei"}), "dst", width, {"eps": "ej"})

    def half(eps):
        ratio = F.when(F.col(eps) > 0, F.col("w") / F.col(eps)).otherwise(F.when(F.col("w") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
        return F.exp(-F.pow(ratio, F.lit(float(decay))))

    k = both.select("src", "dst", (F.lit(0.5) * half("ei") + F.lit(0.5) * half("ej")).alias("w")).filter(F.col("w") >= floor)
    own = nb.nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))
    out = cut(k.unionByName(own))
    links.close()
    return out


def entropy_knee(p: np.ndarray, t_max: int = 100) -> int:
    """Bend of the spectral entropy of p^t: the split with the least squared error of two straight lines."""
    s = np.linalg.svd(p, compute_uv=False)
    h = []
    for t in range(1, t_max + 1):
        q = s**t
        q = q / q.sum()
        h.append(float(-(q[q > 0] * np.log(q[q > 0])).sum()))
    x, y = np.arange(1, t_max + 1, dtype=float), np.array(h)

    def error(a, b):
        if len(a) < 2:
            return 0.0
        fit = np.polyfit(a, b, 1)
        return float(((np.polyval(fit, a) - b) ** 2).sum())

    cost = [error(x[:i + 1], y[:i + 1]) + error(x[i:], y[i:]) for i in range(1, t_max - 1)]
    return int(x[1 + int(np.argmin(cost))])


def phate_operator(nb: Neighbours, kernel: DataFrame, landmarks: int, seed: int):
    """node, cluster, p (rows sum to one) and the L x L landmark operator."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    count = min(landmarks, nb.n)
    feats = nb.nodes.select("node", array_to_vector("embedding").alias("features"))
    model = KMeans(k=count, seed=seed, maxIter=5).fit(feats)
    cluster = cut(model.transform(feats).select("node", F.col("prediction").alias("cluster")))
    degree = kernel.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg"))
    links = Links(kernel, nb.n, 24)
    to = links.attach(links.edges, "dst", cluster)
    p_nl = cut(to.groupBy(F.col("src").alias("node"), "cluster").agg(F.sum("w").alias("w")).join(degree, "node")
               .select("node", "cluster", (F.col("w") / F.col("deg")).alias("p"), "w"))
    links.close()
    # P_LN P_NL: the rows of a batch meet their clusters in two matrices of ``size`` columns, whose product is summed.
    size = cluster.agg(F.max("cluster")).first()[0] + 1
    per_node = p_nl.groupBy("node").agg(F.collect_list(F.struct("cluster", "w", "p")).alias("c")).select("c.cluster", "c.w", "c.p")

    def part(batch):
        out = np.zeros((size, size))
        for first in range(0, batch.num_rows, 4096):
            few = batch.slice(first, 4096)
            at = np.repeat(np.arange(few.num_rows), few.column(0).value_lengths().to_numpy(zero_copy_only=False))
            w, p = np.zeros((2, few.num_rows, size))
            for matrix, column in ((w, 1), (p, 2)):
                matrix[at, few.column(0).flatten().to_numpy()] = few.column(column).flatten().to_numpy()
            out += w.T @ p
        return [out]

    op = sum_arrays(per_node, part)[0]
    total = op.sum(axis=1, keepdims=True)
    return p_nl.select("node", "cluster", "p"), op / np.where(total > 0, total, 1.0)


def potential(op: np.ndarray, t: int, gamma: float) -> np.ndarray:
    power = np.linalg.matrix_power(op, t)
    if gamma == 1:
        return -np.log(power + 1e-7)
    if gamma == -1:
        return power
    return 2.0 / (1.0 - gamma) * power ** ((1.0 - gamma) / 2.0)


def kernel_neighbours(df: DataFrame, knn: int, decay: float, backend: str = "exact", floor: float = 1e-4, **options) -> Neighbours:
    """All neighbours that the kernel lifts above half its floor from either end.

    A row whose last entry lies within its own reach asks once more, for all rows up to that reach; rows that are
    done keep their list. A pair is in the list of at least one end wherever its weight reaches the floor.
    """
    reach = math.log(1 / floor) ** (1.0 / decay)
    k = 4 * knn
    nb = neighbours(df, k, backend, **options)
    if k >= nb.n - 1:
        return nb
    eps = nb.knn.filter(F.col("rank") <= knn).groupBy("src").agg(F.max("dist").alias("eps"))
    last = nb.knn.groupBy("src").agg(F.max("dist").alias("last"), F.count(F.lit(1)).alias("n"))
    # A little more than the reach, for what rounding takes off.
    far = F.col("eps") * (reach * (1 + 1e-9))
    open_ = cut(last.filter(F.col("n") >= k).join(eps, "src").filter(F.col("last") <= far).select(F.col("src").alias("node"), far.alias("far")))
    if open_.isEmpty():
        return nb
    wider = knn_exact(nb.nodes, None, key="node", n=nb.n, only=open_, reach="far")
    done = nb.knn.join(open_.select(F.col("node").alias("src")), "src", "left_anti").select("src", "rank", "dst", "dist")
    return replace(nb, knn=cut(done.unionByName(wider), replaces=nb.knn))


@method("phate")
def phate(df: DataFrame, params: dict) -> DataFrame:
    nb = kernel_neighbours(df, params["knn"], params["decay"], params["backend"], **neighbour_options(params))
    kernel = decay_kernel(nb, params["knn"], params["decay"])
    p_nl, op = phate_operator(nb, kernel, params["landmarks"], params["random_state"])
    t = entropy_knee(op) if str(params["t"]) == "auto" else int(float(params["t"]))
    u = potential(op, t, params["gamma"])
    sq = ((u[:, None, :] - u[None, :, :]) ** 2).sum(axis=2)
    start, _ = classical_mds(sq, params["n_components"])
    marks, _ = smacof(np.sqrt(sq), start, 300, 1e-6)
    table = df.sparkSession.createDataFrame([(c, float(x), float(y)) for c, (x, y) in enumerate(marks[:, :2])], "cluster int, mx double, my double")
    coords = p_nl.join(F.broadcast(table), "cluster").groupBy("node").agg(
        F.sum(F.col("p") * F.col("mx")).alias("x"), F.sum(F.col("p") * F.col("my")).alias("y"))
    return nb.back(coords)
