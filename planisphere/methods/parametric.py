"""Methods whose model is a set of small parameters: a repulsive network map and local linear prototypes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.functions.seeded import u01_value
from planisphere.functions.vectors import as_xy, map_matrix, to_lists, to_matrix
from planisphere.methods.layout import EXTRA, pacmap_loss, pacmap_pairs, pacmap_pull, pacmap_pull_here, phase, reduced
from planisphere.operators.graph import Links, Neighbours, neighbours
from planisphere.operators.layout import both_ways, moved
from planisphere.operators.moments import moments, standardise, sum_arrays
from planisphere.operators.one_task import in_one_task, sums
from planisphere.operators.prepare import preprocess_pca
from planisphere.operators.subset import label_encode
from planisphere.registry import method, neighbour_options
from planisphere.session import cut

# --- network map


def uniform_matrix(seed, rows: int, cols: int) -> np.ndarray:
    limit = np.sqrt(6.0 / (rows + cols))
    return np.array([[(2 * u01_value(seed, r, c) - 1) * limit for c in range(cols)] for r in range(rows)])


def network(d: int, hidden: int, seed) -> list[np.ndarray]:
    """Weights and biases of d -> hidden -> 2."""
    return [uniform_matrix(f"{seed}:1", d, hidden), np.zeros(hidden), uniform_matrix(f"{seed}:2", hidden, 2), np.zeros(2)]


def forward(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]


def backward(x: np.ndarray, g: np.ndarray, w: list[np.ndarray]) -> list[np.ndarray]:
    """Summed gradient of the weights for the gradient ``g`` of the outputs."""
    h = np.tanh(x @ w[0] + w[1])
    back = (g @ w[2].T) * (1 - h * h)
    return [x.T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0)]


def positions(nodes: DataFrame, w: list[np.ndarray]) -> DataFrame:
    return as_xy(map_matrix(nodes.select("node", "embedding"), "embedding", lambda x: forward(x, w)))


def repulsor_here(links: Links, nodes: DataFrame, w: list[np.ndarray], epochs: int, rate: float) -> list[np.ndarray]:
    """The network after all epochs, in one task."""

    def run(edges, rows):
        x, src, dst, now = rows["embedding"], edges["src"], edges["dst"], [a.copy() for a in w]
        near, mid = edges["kind"] == "near", edges["kind"] == "mid"
        m, v = [np.zeros_like(a) for a in now], [np.zeros_like(a) for a in now]
        for t in range(epochs):
            y = forward(x, now)
            gap = y[src] - y[dst]
            pull = sums(src, pacmap_pull_here(near, mid, (gap * gap).sum(axis=1), t, epochs)[:, None] * gap, len(x))
            descend(now, m, v, backward(x, pull, now), len(x), t, rate)
        return {"part": np.arange(len(now)), "w": pa.array([a.reshape(-1) for a in now], pa.list_(pa.float64()))}

    made = {r["part"]: r["w"] for r in in_one_task(links, nodes.select("node", "embedding"), run, "part bigint, w array<double>").collect()}
    return [np.array(made[i]).reshape(a.shape) for i, a in enumerate(w)]


def descend(w: list[np.ndarray], m: list[np.ndarray], v: list[np.ndarray], grad: list[np.ndarray], n: int, t: int, rate: float) -> None:
    """One step of the weights with running moments, in place."""
    for i, g in enumerate(grad):
        g = g / n
        m[i] = 0.9 * m[i] + 0.1 * g
        v[i] = 0.999 * v[i] + 0.001 * g * g
        step = (m[i] / (1 - 0.9 ** (t + 1))) / (np.sqrt(v[i] / (1 - 0.999 ** (t + 1))) + 1e-8)
        w[i] = w[i] - 0.01 * rate * step


def fit_repulsor(df: DataFrame, params: dict) -> tuple[Neighbours, list[np.ndarray], list[float]]:
    """The trained network and its loss per epoch.

    An epoch is one job without state on the rows: outputs from the current
    weights, pair forces by a join, and the summed weight gradient.
    """
    base = standardise(reduced(df, params, 100))
    nb = neighbours(base, params["n_neighbors"] + EXTRA, params["backend"], **neighbour_options(params))
    pairs = pacmap_pairs(nb, min(params["n_neighbors"], nb.n - 1), params["MN_ratio"], params["FP_ratio"], params["random_state"])
    links = Links(both_ways(pairs, "kind"), nb.n, 32)
    d = len(nb.nodes.select("embedding").first()[0])
    w = network(d, params["hidden"], params["random_state"])
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    alone = links.fits_task(8 * (2 * d + 4 * params["hidden"]), 160)
    if alone:
        w = repulsor_here(links, nb.nodes, w, params["n_epochs"], params["lr"])
    for t in range(0 if alone else params["n_epochs"]):
        y = cut(positions(nb.nodes, w).withColumn("t", F.lit(float(t))))
        pull = moved(links, y, pacmap_pull(*phase(params["n_epochs"]))).select("node", "gx", "gy")

        def part(batch, w=w):
            g = np.column_stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            return backward(to_matrix(batch.column(0)), g, w)

        grad = sum_arrays(nb.nodes.join(pull, "node").select("embedding", "gx", "gy"), part)
        descend(w, m, v, grad, nb.n, t, params["lr"])
    history = [pacmap_loss(links, positions(nb.nodes, u)) for u in (network(d, params["hidden"], params["random_state"]), w)]
    links.close()
    return nb, w, history


@method("paramrepulsor")
def paramrepulsor(df: DataFrame, params: dict) -> DataFrame:
    nb, w, _ = fit_repulsor(df, params)
    return nb.back(positions(nb.nodes, w))


# --- local linear models around prototypes


def prototypes(count: int, radius: float) -> np.ndarray:
    """Points of a sunflower spiral filling a disc of twice the radius."""
    k = np.arange(count) + 0.5
    r, a = 2.0 * radius * np.sqrt(k / count), k * np.pi * (3.0 - np.sqrt(5.0))
    return np.stack([r * np.cos(a), r * np.sin(a)], axis=1)


def lasso_normal(g: np.ndarray, b: np.ndarray, alpha: float, sweeps: int = 100) -> np.ndarray:
    """min 1/2 c'Gc - b'c + alpha |c| without penalty on the last entry."""
    c = np.zeros(len(b))
    for _ in range(sweeps):
        for i in range(len(b)):
            if g[i, i] <= 1e-12:
                continue
            r = b[i] - g[i] @ c + g[i, i] * c[i]
            cut_at = alpha if i < len(b) - 1 else 0.0
            c[i] = np.sign(r) * max(abs(r) - cut_at, 0.0) / g[i, i]
    return c


def place_rows(loss: np.ndarray, proto: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Positions with the smallest softmax-weighted loss and their weights.

    The search starts at the best prototype and tries shrinking steps in eight directions.
    """
    def weigh(z):
        s = -np.sqrt(((z[:, None, :] - proto[None, :, :]) ** 2).sum(axis=2))
        w = np.exp(s - s.max(axis=1, keepdims=True))
        return w / w.sum(axis=1, keepdims=True)

    z = proto[np.argmin(loss, axis=1)].copy()
    best = (weigh(z) * loss).sum(axis=1)
    size = np.sqrt((proto**2).sum(axis=1).max()) / 4
    turns = [np.array([np.cos(a), np.sin(a)]) for a in np.arange(8) * np.pi / 4]
    for _ in range(rounds):
        for turn in turns:
            trial = z + size * turn
            value = (weigh(trial) * loss).sum(axis=1)
            take = value < best
            z[take], best[take] = trial[take], value[take]
        size *= 0.7
    return z, weigh(z)


def fit_slisemap(df: DataFrame, params: dict) -> tuple[DataFrame, np.ndarray, np.ndarray, list[float]]:
    """Prepared rows, prototypes, one linear model per prototype, and the loss per round.

    Both flags of the method use prototypes: with n x n models nothing would scale.
    Every round is one pass that places the rows and sums the weighted normal
    equations of all prototypes.
    """
    coded = label_encode(df, "group_key", "y") if params["y"] is None else df.withColumn("y", F.col(params["y"]))
    short = preprocess_pca(coded.select("item_id", "group_key", F.col("y").cast("double").alias("y"), "embedding"), 50)
    rows = standardise(short.select("item_id", "group_key", "y", "embedding"))
    stat = rows.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
    centre, spread = float(stat["m"] or 0.0), float(stat["s"] or 1.0) or 1.0
    proto = prototypes(params["prototypes"], params["radius"])
    d = moments(rows.limit(1)).dim
    models = np.array([[(2 * u01_value(params["random_state"], p, c) - 1) * 0.1 for c in range(d + 1)] for p in range(len(proto))])
    history = []
    for _ in range(params["max_iter"]):
        def part(batch, models=models):
            x, y = to_matrix(batch.column(1)), (batch.column(0).to_numpy() - centre) / spread
            ones = np.hstack([x, np.ones((len(x), 1))])
            loss = (ones @ models.T - y[:, None]) ** 2
            _, w = place_rows(loss, proto)
            g = np.einsum("np,na,nb->pab", w, ones, ones, optimize=True)
            return [g, np.einsum("np,na,n->pa", w, ones, y, optimize=True), np.array((w * loss).sum()), np.array(float(len(x)))]

        g, b, loss, n = sum_arrays(rows.select("y", "embedding"), part)
        history.append(float(loss) / float(n) + params["lasso"] * float(np.abs(models[:, :-1]).sum()) / len(proto))
        weight = np.maximum(g[:, -1, -1], 1e-9)
        models = np.array([lasso_normal(g[p] / weight[p], b[p] / weight[p], params["lasso"]) for p in range(len(proto))])
    return rows, proto, (models, centre, spread), history


@method("slisemap")
def slisemap(df: DataFrame, params: dict) -> DataFrame:
    rows, proto, (models, centre, spread), _ = fit_slisemap(df, params)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = to_matrix(batch.column(3)), (batch.column(2).to_numpy() - centre) / spread
            loss = (np.hstack([x, np.ones((len(x), 1))]) @ models.T - y[:, None]) ** 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), to_lists(place_rows(loss, proto)[0])], names=["item_id", "group_key", "xy"])

    source = rows.select("item_id", "group_key", "y", "embedding")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:2])
    placed = source.mapInArrow(run, f"{kinds}, xy array<double>").select("item_id", "group_key", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
    # Root mean square distance from the origin becomes the radius.
    size = placed.agg(F.sqrt(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")))).first()[0] or 1.0
    f = F.lit(params["radius"] / size)
    return placed.select("item_id", "group_key", (F.col("x") * f).alias("x"), (F.col("y") * f).alias("y"))
