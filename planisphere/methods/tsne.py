"""t-SNE with repulsion from a grid or a quadtree, and its particle-swarm form."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.functions.seeded import normal
from planisphere.operators.graph import Links, Neighbours, neighbours
from planisphere.operators.knn import symmetrise
from planisphere.operators import one_task
from planisphere.operators.layout import (
    delta_bar_delta, gather, grid_here, messages, moved, read_repulsion, repulsion_grid, start_pca, start_random, take_repulsion, update,
)
from planisphere.operators.one_task import in_one_task, sums
from planisphere.operators.quadtree import tree_repulsion
from planisphere.registry import method, neighbour_options
from planisphere.session import cut


def calibrate(d2: np.ndarray, perplexity: float, rounds: int = 100) -> np.ndarray:
    """Row-stochastic exp(-beta d^2) whose entropy is ln(perplexity)."""
    n = len(d2)
    target = math.log(min(perplexity, d2.shape[1]))
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    base = d2 - d2.min(axis=1, keepdims=True)
    for _ in range(rounds):
        p = np.exp(-base * beta[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + beta * (base * p).sum(axis=1) / total
        flat = entropy > target
        low = np.where(flat, beta, low)
        high = np.where(flat, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
        # A row of equal distances has one entropy only.
        beta = np.minimum(beta, 1e12)
    p = np.exp(-base * beta[:, None])
    return p / p.sum(axis=1, keepdims=True)


def conditional(nb: Neighbours, perplexity: float) -> DataFrame:
    """src, dst, w: p(j|i) over the listed neighbours."""
    lists = nb.knn.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("near")).select(
        "src", F.col("near.dst").alias("dst"), F.col("near.dist").alias("dist"))

    def run(batches):
        for batch in batches:
            counts = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(counts)])
            w = np.zeros(len(flat))
            for size in np.unique(counts):
                where = first[np.flatnonzero(counts == size)][:, None] + np.arange(size)[None, :]
                w[where] = calibrate(flat[where] ** 2, perplexity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), counts)), batch.column(1).flatten(), pa.array(w)], names=["src", "dst", "w"])

    return lists.mapInArrow(run, "src bigint, dst bigint, w double")


def affinities(nb: Neighbours, perplexity: float) -> DataFrame:
    """src, dst, p in both directions; p sums to one."""
    return symmetrise(conditional(nb, perplexity), "mean").select("src", "dst", (F.col("w") / F.lit(float(nb.n))).alias("p"))


#: Bytes of a row that a broadcast of several rows per node takes, its two keys and the table of them included.
PARTICLE_BYTES = 128


def prepare(df: DataFrame, params: dict, particles: int = 1) -> tuple[Neighbours, Links]:
    """The neighbours, and the affinities as links; each of several ``particles`` has a row of every node."""
    listed = int(3 * params["perplexity"])
    nb = neighbours(df, listed, params["backend"], params["metric"], **neighbour_options(params))
    return nb, Links(affinities(nb, params["perplexity"]), nb.n, 40 if particles == 1 else PARTICLE_BYTES * particles)


def totals(links: Links, state: DataFrame, sum_q: np.ndarray) -> dict[int, float]:
    """Kullback-Leibler divergence per particle from the edges and the pair sum of q."""
    also = ["particle"] if "particle" in state.columns else []
    e = links.attach(links.edges, "dst", state, {"x": "xj", "y": "yj"}, also)
    e = links.attach(e, "src", state, {"x": "xi", "y": "yi"}, also)
    part = "particle" if also else "0"
    rows = e.selectExpr(f"{part} AS c", "p", "ln(1 + pow(xi - xj, 2) + pow(yi - yj, 2)) AS l").groupBy("c").agg(
        F.sum(F.expr("p * (ln(p) + l)")).alias("k"), F.sum("p").alias("s")).collect()
    return {r["c"]: r["k"] + r["s"] * math.log(max(sum_q[r["c"]], 1e-300)) for r in rows}


def divergence(links: Links, state: DataFrame, n: int, particles: int = 1, repulsion: str = "fft", theta: float = 0.5) -> dict[int, float]:
    if repulsion == "bh":
        total = np.array([tree_repulsion(state, theta).agg(F.sum("q")).first()[0] or 0.0])
    else:
        _, total = repulsion_grid(state, particles)
    return totals(links, state, total - n)


def pushed(pulled: DataFrame, state: DataFrame, n: int, repulsion: str = "fft", theta: float = 0.5) -> tuple[DataFrame, float]:
    """``pulled`` with the repulsion of all points taken off gx and gy, and the pair sum of q.

    ``fft`` reads it from a grid, in the same pass that sums the pulls; ``bh`` from a quadtree opened by ``theta``.
    """
    if repulsion == "bh":
        push = cut(tree_repulsion(state, theta))
        z = max((push.agg(F.sum("q")).first()[0] or 0.0) - n, 1e-12)
        share = F.lit(4.0 / z)
        joined = pulled.join(push.drop("q"), "node", "left")
        whole = joined.withColumns({f"g{c}": F.col(f"g{c}") - share * F.col(f"r{c}") for c in "xy"})
        return whole.select(*pulled.columns), z
    grid, total = repulsion_grid(state)
    z = max(float(total[0]) - n, 1e-12)
    return take_repulsion(pulled, grid, 4.0 / z), z


def gradient(links: Links, state: DataFrame, n: int, exaggeration: float, particles: int = 1, repulsion: str = "fft", theta: float = 0.5) -> tuple[DataFrame, np.ndarray]:
    """Keys, gx, gy for every row of the state, and the pair sum of q per particle."""
    pull = f"4D * {float(exaggeration)!r}D * p / (1D + d2)"
    if "particle" not in state.columns:
        whole, z = pushed(moved(links, state, pull), state, n, repulsion, theta)
        return whole.select("node", "gx", "gy"), np.array([z])
    keys = ["node", "particle"]
    grid, total = repulsion_grid(state, particles)
    z = np.maximum(total - n, 1e-12)
    pulls = gather(messages(links, state, pull, ["particle"]))
    share = "element_at(array(" + ", ".join(f"{4.0 / float(v)!r}D" for v in z) + "), particle + 1)"
    push = read_repulsion(state, grid).selectExpr(*keys, f"-rx * {share} AS rx", f"-ry * {share} AS ry")
    return push.join(pulls, keys, "left").selectExpr(*keys, "rx + coalesce(gx, 0D) AS gx", "ry + coalesce(gy, 0D) AS gy"), z


def tsne_here(links: Links, state: DataFrame, params: dict) -> DataFrame:
    """All steps of t-SNE with grid repulsion in one task."""
    early, exaggeration, rate = params["early_exaggeration_iter"], params["early_exaggeration"], params["learning_rate"]

    def run(edges, nodes):
        src, dst, p = edges["src"], edges["dst"], edges["p"]
        n = len(nodes["node"])
        place, speed, gain = (np.stack([nodes[a], nodes[b]], axis=1) for a, b in (("x", "y"), ("vx", "vy"), ("kx", "ky")))
        for t in range(early + params["n_iter"]):
            gap = place[src] - place[dst]
            pull = 4.0 * (exaggeration if t < early else 1.0) * p / (1.0 + (gap * gap).sum(axis=1))
            grid, total = grid_here(place[:, 0], place[:, 1])
            f = grid.read(place[:, 0], place[:, 1], np.zeros(n, int))
            g = sums(src, pull[:, None] * gap, n) - 4.0 / max(total - n, 1e-12) * (place * f[:, 1:2] - f[:, 2:])
            speed, gain = one_task.delta_bar_delta(g, speed, gain, rate, 0.5 if t < early else 0.8)
            place = place + speed
        pairs = {"x": place, "v": speed, "k": gain}
        return {"node": nodes["node"], "x": place[:, 0], "y": place[:, 1], **{f"{c}{d}": pairs[c][:, at] for c in "vk" for at, d in enumerate("xy")},
                "t": np.full(n, float(early + params["n_iter"]))}

    return in_one_task(links, state, run, ", ".join(f"{c} {k}" for c, k in state.dtypes))


def fit_tsne(df: DataFrame, params: dict) -> tuple[Neighbours, Links, DataFrame, DataFrame]:
    repulsion, theta = params["negative_gradient_method"], params["theta"]
    if repulsion not in ("fft", "bh"):
        raise ValueError(f"unknown negative_gradient_method {repulsion!r}")
    nb, links = prepare(df, params)
    start = start_random(nb, 1e-4, params["random_state"]) if params["initialization"] == "random" else start_pca(nb, 1e-4)
    start = cut(start)
    state = cut(start.selectExpr("node", "x", "y", "0D AS vx", "0D AS vy", "1D AS kx", "1D AS ky", "0D AS t"))
    # The extra rounds of early exaggeration come before n_iter plain ones.
    early = f"t < {float(params['early_exaggeration_iter'])!r}D"
    pull = f"4D * (CASE WHEN {early} THEN {float(params['early_exaggeration'])!r}D ELSE 1D END) * p / (1D + d2)"
    change = delta_bar_delta(params["learning_rate"], f"(CASE WHEN {early} THEN 0.5D ELSE 0.8D END)")
    if repulsion == "fft" and links.fits_task(256, 160):
        return nb, links, start, tsne_here(links, state, params)
    for _ in range(params["early_exaggeration_iter"] + params["n_iter"]):
        whole, _ = pushed(moved(links, state, pull), state, nb.n, repulsion, theta)
        state = update(whole, change, state)
    return nb, links, start, state


@method("tsne")
def tsne(df: DataFrame, params: dict) -> DataFrame:
    nb, links, _, state = fit_tsne(df, params)
    links.close()
    return nb.back(state.select("node", "x", "y"))


# --- particle swarm


def fit_swarm(df: DataFrame, params: dict) -> tuple[Neighbours, DataFrame, list[float]]:
    """Nodes, best positions and the best divergence per round.

    A particle is a whole map: the state has one row per (particle, node). The
    personal best moves only when the divergence of that particle falls; the
    swarm's best is the particle with the smallest divergence so far.
    """
    count, seed, node = params["n_particles"], params["random_state"], F.col("node")
    nb, links = prepare(df, params, count)
    base = start_pca(nb, 1e-2) if params["init"] == "pca" else start_random(nb, 1e-2, seed)
    spread = base.select("node", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("particle"))
    jitter = F.when(F.col("particle") == 0, F.lit(0.0)).otherwise(F.lit(1e-3))
    start = spread.select(
        node, F.col("particle").cast("int").alias("particle"), (F.col("x") + normal(seed, node, F.col("particle"), "x") * jitter).alias("x"),
        (F.col("y") + normal(seed, node, F.col("particle"), "y") * jitter).alias("y"))
    state = cut(start.selectExpr("*", "0D AS vx", "0D AS vy", "x AS bx", "y AS by"))
    best = divergence(links, state, nb.n, count)
    history = [min(best.values())]
    early = min(params["early_exaggeration_iter"], params["n_iter"] // 4)
    for t in range(params["n_iter"]):
        leader = min(best, key=lambda c: (best[c], c))
        # h and f raise the social and lower the cognitive pull as the rounds go on.
        social = params["social_weight"] + params["h"] * t
        personal = max(params["cognitive_weight"] - params["f"] * t, 0.0)
        lead = state.filter(F.col("particle") == leader).select("node", F.col("bx").alias("lx"), F.col("by").alias("ly"))
        joined = state.join(F.broadcast(lead) if links.small else lead, "node")
        hybrid = params["use_hybrid"]
        if hybrid:
            pulls, _ = gradient(links, state, nb.n, params["early_exaggeration"] if t < early else 1.0, count)
            joined = joined.join(pulls, ["node", "particle"], "left")
        cells = {}
        for c in "xy":
            r1, r2 = (f"(pmod(xxhash64({seed}, {t}, '{c}{i}', particle, node), 1000003) / 1000003D)" for i in (1, 2))
            v = (f"{params['inertia_weight']!r}D * v{c} + {personal!r}D * {r1} * (b{c} - {c}) + {social!r}D * {r2} * (l{c} - {c})")
            if hybrid:
                v += f" - {params['learning_rate'] / count!r}D * coalesce(g{c}, 0D)"
            cells[c] = v
        state = cut(joined.selectExpr("node", "particle", "bx", "by", "x", "y", f"{cells['x']} AS vx", f"{cells['y']} AS vy").selectExpr(
            "node", "particle", "x + vx AS x", "y + vy AS y", "vx", "vy", "bx", "by"), replaces=state)
        now = divergence(links, state, nb.n, count)
        better = [c for c in now if now[c] < best[c]]
        if better:
            best.update({c: now[c] for c in better})
            mine = f"particle IN ({', '.join(map(str, better))})"
            state = state.selectExpr("node", "particle", "x", "y", "vx", "vy", f"if({mine}, x, bx) AS bx", f"if({mine}, y, by) AS by")
            state = cut(state)
        history.append(min(best.values()))
    leader = min(best, key=lambda c: (best[c], c))
    links.close()
    return nb, state.filter(F.col("particle") == leader).selectExpr("node", "bx AS x", "by AS y"), history


@method("tsne_pso")
def tsne_pso(df: DataFrame, params: dict) -> DataFrame:
    nb, coords, _ = fit_swarm(df, params)
    return nb.back(coords)
