"""Neighbour layouts: UMAP, PaCMAP, TriMap and SpaceMAP as repeated joins over pair tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.methods.graph import oriented, spectral_vectors
from planisphere.operators.graph import Links, Neighbours, connect, neighbours
from planisphere.operators.knn import symmetrise
from planisphere.operators.layout import (
    adam, both_ways, delta_bar_delta, gather, mid_pairs, moved, near_pairs, other_node, scaled_distances, start_pca,
    start_random, step, update, with_distance, with_state,
)
from planisphere.operators import one_task
from planisphere.operators.one_task import in_one_task, sums, xxhash64
from planisphere.operators.pairs import random_pairs
from planisphere.operators.prepare import preprocess_pca
from planisphere.registry import method, neighbour_options
from planisphere.session import cut

# --- UMAP


def smooth_distances(d: np.ndarray, local: float, rounds: int = 64, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """rho and sigma per row of sorted neighbour distances, so that sum exp(-(d - rho) / sigma) = log2 of ``size`` (k where unset)."""
    n, k = d.shape
    whole, part = int(math.floor(local)), local - math.floor(local)
    zeros, rows = (d <= 0).sum(axis=1), np.arange(n)

    def positive(nth):
        """The nth positive distance of every row, counted from one, 0 for none."""
        at = zeros + nth - 1
        return np.where((nth > 0) & (at < k), d[rows, np.clip(at, 0, k - 1)], 0.0)

    following = positive(whole + 1)
    exact = positive(whole) + np.where((part > 1e-5) & (following > 0), part * (following - positive(whole)), 0.0)
    short = part * positive(1) if whole == 0 else np.maximum(d[:, -1], 0.0)
    rho = np.where((k - zeros >= local) & (whole > 0), exact, np.where(zeros < k, short, 0.0))
    target = math.log2(max(size or k, 2))
    low, high, mid = np.zeros(n), np.full(n, np.inf), np.ones(n)
    gap = np.maximum(d - rho[:, None], 0.0)
    for _ in range(rounds):
        total = np.exp(-gap / mid[:, None]).sum(axis=1)
        over = total > target
        high = np.where(over, mid, high)
        low = np.where(over, low, mid)
        mid = np.where(np.isinf(high), mid * 2, (low + high) / 2)
    return rho, np.maximum(mid, 1e-3 * np.maximum(d.mean(axis=1), 1e-12))


def membership(nb: Neighbours, local: float, size: int | None = None) -> DataFrame:
    """src, dst, w: the directed fuzzy strengths of the neighbour edges."""
    lists = nb.knn.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("near")).select(
        "src", F.col("near.dst").alias("dst"), F.col("near.dist").alias("dist"))

    def run(batches):
        for batch in batches:
            counts = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(counts)])
            w = np.zeros(len(flat))
            for many in np.unique(counts):
                at = np.flatnonzero(counts == many)
                where = first[at][:, None] + np.arange(many)[None, :]
                rho, sigma = smooth_distances(flat[where], local, size=size)
                w[where] = np.exp(-np.maximum(flat[where] - rho[:, None], 0.0) / sigma[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), counts)), batch.column(1).flatten(), pa.array(w)], names=["src", "dst", "w"])

    return lists.mapInArrow(run, "src bigint, dst bigint, w double")


def fuzzy_graph(nb: Neighbours, local: float, mix: float, size: int | None = None) -> DataFrame:
    return symmetrise(membership(nb, local, size), "fuzzy", mix=mix)


def curve(min_dist: float, spread: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^(2b)) closest to 1 below min_dist and an exponential beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([0.0, 0.0]), 1e-2

    def miss(q):
        a, b = np.exp(q)
        return 1.0 / (1.0 + a * x ** (2 * b)) - y

    for _ in range(200):
        r = miss(p)
        jac = np.stack([(miss(p + np.eye(2)[c] * 1e-6) - r) / 1e-6 for c in range(2)], axis=1)
        move = np.linalg.solve(jac.T @ jac + damp * np.eye(2), -jac.T @ r)
        if (miss(p + move) ** 2).sum() < (r**2).sum():
            p, damp = p + move, damp / 3
        else:
            damp *= 3
    return float(np.exp(p[0])), float(np.exp(p[1]))


def umap_start(nb: Neighbours, edges: DataFrame, params: dict) -> DataFrame:
    if params["init"] == "random":
        return start_random(nb, 5.0, params["random_state"])
    if params["init"] == "pca":
        return start_pca(nb, 5.0)
    found, _ = spectral_vectors(nb, connect(nb, edges, close=F.lit(1e-3)), 2, 24, 1e-2, params["random_state"])
    xy = oriented(found.vectors, 2)
    top = xy.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    seed, node = params["random_state"], F.col("node")
    from planisphere.functions.seeded import normal

    return xy.select("node", (F.col("x") * (10.0 / top) + normal(seed, node, "jx") * 1e-4).alias("x"),
                     (F.col("y") * (10.0 / top) + normal(seed, node, "jy") * 1e-4).alias("y"))


def attract_repel(links: Links, state: DataFrame, n: int, epochs: int, rate: float, attract: str, repel: str, negatives: int, seed: int) -> DataFrame:
    """One epoch: sampled edges attract, ``negatives`` random nodes per node repel.

    An edge takes part with probability w. The repulsion of a node is scaled by its
    expected number of active edges, so the random pairs number n * negatives and
    not edges * negatives. ``t``, a column of the state, counts the epochs; the rate falls to zero with it.
    """
    active = f"pmod(xxhash64({seed}, cast(t AS int), src, dst), 1000003) / 1000003D < w"
    partner = f"pmod(src + 1 + pmod(xxhash64({seed}, cast(t AS int), src, slot), {max(n - 1, 1)}), {n})"
    slots = f"sequence(0, {negatives - 1})" if negatives > 0 else "array()"
    if links.small:
        own = state.select(F.col("node").alias("src"), F.struct("node", "x", "y", "deg", "t").alias("own"))
        e = links.by_source(state).withColumnRenamed("dst", "to").join(F.broadcast(own), "src")
        # The edge of a node to itself stands for its random partners.
        e = e.selectExpr("src", "to", "w", "own", "own.t AS t", f"explode(CASE WHEN src = to THEN concat(array(-1), {slots}) ELSE array(-1) END) AS slot")
        e = e.selectExpr("*", f"CASE WHEN slot < 0 THEN to ELSE {partner} END AS dst")
        other = state.selectExpr("node AS dst", "x AS xj", "y AS yj")
        e = e.join(F.broadcast(other), "dst").selectExpr("*", "own.x - xj AS dx", "own.y - yj AS dy", "own.deg AS deg").selectExpr("*", "dx * dx + dy * dy AS d2")
        pull = f"CASE WHEN slot < 0 AND src <> to AND {active} THEN {attract} ELSE 0D END"
        e = e.selectExpr("src", "own", "dx", "dy", f"{pull} AS pull", f"CASE WHEN slot < 0 THEN 0D ELSE deg * least({repel}, 4D / (sqrt(d2) + 1e-9D)) END AS push")
        sums = e.groupBy("src").agg(F.first("own").alias("own"), F.expr("sum((push - pull) * dx) AS gx"), F.expr("sum((push - pull) * dy) AS gy"), F.sum("pull").alias("gc"))
        joined = sums.selectExpr("own.*", "gx", "gy", "gc")
    else:
        at = state.selectExpr("node", "x", "y", "deg", "t")
        e = links.attach(links.edges, "dst", at, {"x": "xj", "y": "yj"})
        e = links.attach(e, "src", at, {"x": "xi", "y": "yi", "t": "t"}).filter(active).selectExpr("src AS node", "xj - xi AS dx", "yj - yi AS dy")
        pull = e.selectExpr("node", "dx", "dy", "dx * dx + dy * dy AS d2").selectExpr("node", f"{attract} AS c", "dx", "dy").selectExpr(
            "node", "c * dx AS gx", "c * dy AS gy", "c AS gc")
        drawn = at.selectExpr("node AS src", "x AS xi", "y AS yi", "deg", "t", f"explode({slots}) AS slot").selectExpr("*", f"{partner} AS dst")
        met = drawn.join(at.selectExpr("node AS dst", "x AS xj", "y AS yj"), "dst").selectExpr(
            "src AS node", "xi - xj AS dx", "yi - yj AS dy", "deg").selectExpr("*", "dx * dx + dy * dy AS d2")
        push = met.selectExpr("node", f"deg * least({repel}, 4D / (sqrt(d2) + 1e-9D)) AS c", "dx", "dy").selectExpr(
            "node", "c * dx AS gx", "c * dy AS gy", "0D AS gc")
        sums = pull.unionByName(push).groupBy("node").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"), F.sum("gc").alias("gc"))
        joined = at.join(sums, "node", "left").selectExpr("node", "x", "y", "deg", "t", *[f"coalesce({c}, 0D) AS {c}" for c in ("gx", "gy", "gc")])
    # All edges act at once, so the step is the semi-implicit one: many pulls end at their mean and never beyond.
    now = f"({float(rate)!r}D * (1D - t / {float(epochs)!r}D))"
    places = {c: f"{c} + greatest(least({now} * g{c} / (1D + {now} * gc), 4D), -4D)" for c in "xy"}
    return cut(joined.selectExpr("node", *[f"{v} AS {c}" for c, v in places.items()], "deg", "t + 1D AS t"), replaces=state)


def attract_repel_here(links: Links, state: DataFrame, n: int, epochs: int, rate: float, attract, repel, negatives: int, seed: int) -> DataFrame:
    """All epochs of :func:`attract_repel` in one task; ``attract`` and ``repel`` are functions of squared distances."""
    slots = np.arange(max(negatives, 0), dtype=np.int32)

    def run(edges, nodes):
        src, dst, w, ids = edges["src"], edges["dst"], edges["w"], nodes["node"]
        place, deg = np.stack([nodes["x"], nodes["y"]], axis=1), nodes["deg"]
        drawn = np.repeat(np.arange(len(ids)), len(slots))
        for t in range(epochs):
            key = np.array([seed], np.int32 if abs(seed) < 2**31 else np.int64), np.array([t], np.int32)
            active = np.flatnonzero((xxhash64(*key, ids[src], ids[dst]) % 1000003) / 1000003.0 < w)
            a, b = src[active], dst[active]
            gap = place[a] - place[b]
            pull = attract((gap * gap).sum(axis=1))
            g, count = -sums(a, pull[:, None] * gap, n), sums(a, pull, n)
            if len(slots):
                partner = (ids[drawn] + 1 + xxhash64(*key, ids[drawn], np.tile(slots, len(ids))) % max(n - 1, 1)) % n
                gap = place[drawn] - place[np.searchsorted(ids, partner)]
                d2 = (gap * gap).sum(axis=1)
                g += sums(drawn, (deg[drawn] * np.minimum(repel(d2), 4.0 / (np.sqrt(d2) + 1e-9)))[:, None] * gap, n)
            now = rate * (1.0 - t / epochs)
            place = place + np.clip(now * g / (1.0 + now * count[:, None]), -4.0, 4.0)
        return {"node": ids, "x": place[:, 0], "y": place[:, 1], "deg": deg, "t": np.full(len(ids), float(epochs))}

    return in_one_task(links, state, run, "node bigint, x double, y double, deg double, t double")


def epochs_of(links: Links, state: DataFrame, n: int, epochs: int, rate: float, curves: tuple, negatives: int, seed: int) -> DataFrame:
    """The state after all epochs; ``curves`` are attraction and repulsion, in SQL and as functions."""
    attract, repel, attract_here, repel_here = curves
    if links.fits_task(128 * (negatives + 1), 160):
        return attract_repel_here(links, state, n, epochs, rate, attract_here, repel_here, negatives, seed)
    for _ in range(epochs):
        state = attract_repel(links, state, n, epochs, rate, attract, repel, negatives, seed)
    return state


def fit_umap(df: DataFrame, params: dict) -> tuple[Neighbours, DataFrame]:
    nb = neighbours(df, params["n_neighbors"] - 1, params["backend"], params["metric"], **neighbour_options(params))
    edges = cut(fuzzy_graph(nb, params["local_connectivity"], params["set_op_mix_ratio"], params["n_neighbors"]).filter(F.col("w") > 0))
    start = umap_start(nb, edges, params)
    a, b = curve(params["min_dist"], params["spread"])
    epochs = params["n_epochs"]
    top = edges.agg(F.max("w")).first()[0] or 1.0
    scaled = edges.select("src", "dst", (F.col("w") / top).alias("w"))
    links = Links(scaled, nb.n, 32)
    deg = links.edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg"))
    state = cut(start.join(deg, "node", "left").select("node", "x", "y", F.coalesce("deg", F.lit(0.0)).alias("deg"), F.lit(0.0).alias("t")))
    attract = f"CASE WHEN d2 > 0 THEN 2D * {a!r}D * {b!r}D * pow(d2, {b - 1!r}D) / (1D + {a!r}D * pow(d2, {b!r}D)) ELSE 0D END"
    repel = f"2D * {b!r}D / ((0.001D + d2) * (1D + {a!r}D * pow(d2, {b!r}D)))"

    def attract_here(d2):
        safe = np.where(d2 > 0, d2, 1.0)
        return np.where(d2 > 0, 2.0 * a * b * safe ** (b - 1) / (1.0 + a * safe**b), 0.0)

    curves = attract, repel, attract_here, lambda d2: 2.0 * b / ((0.001 + d2) * (1.0 + a * d2**b))
    state = epochs_of(links, state, nb.n, epochs, params["learning_rate"], curves, params["negatives"], params["random_state"])
    links.close()
    return nb, state


@method("umap")
def umap(df: DataFrame, params: dict) -> DataFrame:
    nb, state = fit_umap(df, params)
    return nb.back(state.select("node", "x", "y"))


# --- PaCMAP

EXTRA = 50


def reduced(df: DataFrame, params: dict, dims: int = 50) -> DataFrame:
    return preprocess_pca(df, dims) if params.get("apply_pca", True) else df


def pacmap_pairs(nb: Neighbours, k: int, mn_ratio: float, fp_ratio: float, seed: int) -> DataFrame:
    """src, dst, kind: near, mid-near and further pairs of every node."""
    near = cut(near_pairs(nb, k)).select("src", "dst", F.lit("near").alias("kind"))
    parts = [near]
    mids, far = int(round(k * mn_ratio)), int(k * fp_ratio)
    if mids > 0:
        parts.append(mid_pairs(nb, mids, f"{seed}:mid").select("src", "dst", F.lit("mid").alias("kind")))
    if far > 0:
        drawn = random_pairs(nb.nodes.select("node"), nb.n, far, f"{seed}:far", avoid=near, short="all")
        parts.append(drawn.select("src", "dst", F.lit("far").alias("kind")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def phase(total: int) -> tuple[str, str, str]:
    """Weights of near, mid-near and further pairs as SQL over the step t; the phases are 100 : 100 : 250 of 450 steps."""
    first, second = f"{total * 100 / 450!r}D", f"{total * 200 / 450!r}D"
    near = f"(CASE WHEN t < {first} THEN 2D WHEN t < {second} THEN 3D ELSE 1D END)"
    mid = f"(CASE WHEN t < {first} THEN 1000D * (1D - t / {first}) + 3D * (t / {first}) WHEN t < {second} THEN 3D ELSE 0D END)"
    return near, mid, "1D"


def pacmap_pull(near: float | str, mid: float | str, far: float | str) -> str:
    """Derivative of the pair loss by the position of the source, over d2 + 1."""
    near, mid, far = (w if isinstance(w, str) else f"{float(w)!r}D" for w in (near, mid, far))
    d = "(d2 + 1D)"
    return (f"CASE kind WHEN 'near' THEN {near} * 20D / pow(10D + {d}, 2) WHEN 'mid' THEN {mid} * 20000D / pow(10000D + {d}, 2) "
            f"ELSE -{far} * 2D / pow(1D + {d}, 2) END")


def pacmap_pull_here(near: np.ndarray, mid: np.ndarray, d2: np.ndarray, t: int, total: int) -> np.ndarray:
    """:func:`pacmap_pull` under the weights of :func:`phase`; ``near`` and ``mid`` tell the kind of a pair."""
    first, second, d = total * 100 / 450, total * 200 / 450, d2 + 1.0
    a = 2.0 if t < first else 3.0 if t < second else 1.0
    b = 1000.0 * (1.0 - t / first) + 3.0 * (t / first) if t < first else 3.0 if t < second else 0.0
    return np.where(near, a * 20.0 / (10.0 + d) ** 2, np.where(mid, b * 20000.0 / (10000.0 + d) ** 2, -2.0 / (1.0 + d) ** 2))


def pacmap_loss(links: Links, state: DataFrame, weights=(1.0, 1.0, 1.0)) -> float:
    e = links.attach(links.attach(links.edges, "dst", state, {"x": "xj", "y": "yj"}), "src", state, {"x": "xi", "y": "yi"})
    d = "(pow(xi - xj, 2) + pow(yi - yj, 2) + 1)"
    near, mid, far = weights
    return e.selectExpr(f"sum(CASE kind WHEN 'near' THEN {near!r}D * {d} / (10 + {d}) WHEN 'mid' THEN {mid!r}D * {d} / (10000 + {d}) "
                        f"ELSE {far!r}D / (1 + {d}) END) / 2 AS l").first()["l"]


def fit_pacmap(df: DataFrame, params: dict) -> tuple[Neighbours, Links, DataFrame, DataFrame]:
    """Neighbours, pair links, the start and the final state."""
    k = params["n_neighbors"]
    base = preprocess_pca(df, params["preprocess_pca"]) if params["preprocess_pca"] else reduced(df, params, 100)
    nb = neighbours(base, k + EXTRA, params["backend"], **neighbour_options(params))
    pairs = both_ways(pacmap_pairs(nb, min(k, nb.n - 1), params["MN_ratio"], params["FP_ratio"], params["random_state"]), "kind")
    links = Links(pairs, nb.n, 32)
    start = cut(start_random(nb, 1e-4, params["random_state"]) if params["init"] == "random" else start_pca(nb))
    state = with_state(start, mx=0, my=0, vx=0, vy=0, t=0)
    for _ in range(params["num_iters"]):
        state = update(moved(links, state, pacmap_pull(*phase(params["num_iters"]))), adam(params["lr"]), state)
    return nb, links, start, state


@method("pacmap")
def pacmap(df: DataFrame, params: dict) -> DataFrame:
    nb, links, _, state = fit_pacmap(df, params)
    links.close()
    return nb.back(state.select("node", "x", "y"))


# --- TriMap


def tempered_log(t: float, v: str) -> str:
    return f"ln({v})" if abs(t - 1.0) < 1e-5 else f"((pow({v}, {1 - t!r}D) - 1D) / {1 - t!r}D)"


def triplets(nb: Neighbours, inliers: int, outliers: int, randoms: int, temp: float, seed: int) -> DataFrame:
    """i, j, k, w: j is to stay closer to i than k.

    Inliers are near by scaled distance, their outliers are drawn outside the
    neighbour list; random triplets order two random nodes by distance.
    """
    near = cut(near_pairs(nb, inliers))
    parts = []
    scale = nb.knn.filter(F.col("rank").between(4, 6)).groupBy(F.col("src").alias("node")).agg(F.greatest(F.avg("dist"), F.lit(1e-10)).alias("s"))

    def scaled(pairs, end, out):
        d = with_distance(nb, pairs, end, "_d")
        a, b = scale.select(F.col("node").alias("src"), F.col("s").alias("_si")), scale.select(F.col("node").alias(end), F.col("s").alias("_sj"))
        return d.join(a, "src").join(b, end).withColumn(out, F.col("_d") * F.col("_d") / (F.col("_si") * F.col("_sj"))).drop("_d", "_si", "_sj")

    if inliers * outliers > 0:
        drawn = random_pairs(nb.nodes.select("node"), nb.n, inliers * outliers, f"{seed}:out", avoid=nb.knn, short="all")
        far = drawn.select("src", F.col("dst").alias("k"), (F.floor(F.col("slot") / outliers) + 1).cast("int").alias("rank"))
        met = far.join(near.select("src", "rank", F.col("dst").alias("j"), F.col("scaled").alias("sj")), ["src", "rank"])
        parts.append(scaled(met.select("src", "j", "k", "sj"), "k", "sk").select("src", "j", "k", "sj", "sk"))
    if randoms > 0:
        both = nb.nodes.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(randoms - 1))).alias("slot")).select(
            "src", other_node(nb.n, f"{seed}:j", F.col("slot")).alias("j"), other_node(nb.n, f"{seed}:k", F.col("slot")).alias("k")).filter("j <> k")
        d = scaled(scaled(both, "j", "sj"), "k", "sk")
        parts.append(d.selectExpr("src", "if(sj <= sk, j, k) AS j", "if(sj <= sk, k, j) AS k", "least(sj, sk) AS sj", "greatest(sj, sk) AS sk"))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    raw = cut(whole.select(F.col("src").alias("i"), "j", "k", F.exp(F.least(F.col("sk") - F.col("sj"), F.lit(60.0))).alias("w")))
    low = raw.agg(F.min("w").alias("m")).scalar()
    return raw.select("i", "j", "k", (F.col("w") - low).alias("w")).selectExpr("i", "j", "k", f"{tempered_log(temp, '(1D + 50D * w)')} AS w")


def trimap_state(links: Links, state: DataFrame) -> DataFrame:
    """Triplets with all three positions and q = 1 / (1 + d^2) of both pairs."""
    e = links.edges
    for end in reversed(links.ends):
        e = links.attach(e, end, state, {"x": f"x{end}", "y": f"y{end}"})
    return e.selectExpr("i", "j", "k", "w", "xi - xj AS ax", "yi - yj AS ay", "xi - xk AS bx", "yi - yk AS by").selectExpr(
        "*", "1 + ax * ax + ay * ay AS dj", "1 + bx * bx + by * by AS dk")


def trimap_step(links: Links, state: DataFrame, rate: float, momentum: str) -> DataFrame:
    """Gradient of w dj / (dj + dk) with dj, dk = 1 + squared distances, sent to all three nodes."""
    e = trimap_state(links, state).selectExpr("*", "2D * w / pow(dj + dk, 2) AS c").selectExpr(
        "i", "j", "k", "c * dk * ax AS px", "c * dk * ay AS py", "c * dj * bx AS qx", "c * dj * by AS qy")
    sent = e.selectExpr(
        "inline(array(named_struct('node', i, 'gx', px - qx, 'gy', py - qy), named_struct('node', j, 'gx', -px, 'gy', -py), "
        "named_struct('node', k, 'gx', qx, 'gy', qy)))")
    return step(state, gather(sent), ["node"], delta_bar_delta(rate, momentum))


def trimap_here(links: Links, state: DataFrame, rate: float, iterations: int, method: str) -> DataFrame:
    """All steps of :func:`trimap_step` in one task."""

    def run(edges, nodes):
        i, j, k, w = (edges[c] for c in ("i", "j", "k", "w"))
        n = len(nodes["node"])
        place, speed, gain = (np.stack([nodes[a], nodes[b]], axis=1) for a, b in (("x", "y"), ("vx", "vy"), ("kx", "ky")))
        for t in range(iterations):
            a, b = place[i] - place[j], place[i] - place[k]
            dj, dk = 1.0 + (a * a).sum(axis=1), 1.0 + (b * b).sum(axis=1)
            c = 2.0 * w / (dj + dk) ** 2
            p, q = (c * dk)[:, None] * a, (c * dj)[:, None] * b
            g = sums(i, p - q, n) - sums(j, p, n) + sums(k, q, n)
            momentum = 0.0 if method == "sd" else 0.5 if t < 250 else 0.8
            speed, gain = one_task.delta_bar_delta(g, speed, gain if method == "dbd" else np.ones_like(gain), rate, momentum)
            place = place + speed
        pairs = {"x": place, "v": speed, "k": gain}
        return {"node": nodes["node"], "x": place[:, 0], "y": place[:, 1], **{f"{c}{d}": pairs[c][:, at] for c in "vk" for at, d in enumerate("xy")},
                "t": np.full(n, float(iterations))}

    return in_one_task(links, state, run, ", ".join(f"{c} {k}" for c, k in state.dtypes))


def trimap_loss(links: Links, state: DataFrame) -> float:
    return trimap_state(links, state).selectExpr("sum(w * dj / (dj + dk)) AS l").first()["l"]


def fit_trimap(df: DataFrame, params: dict) -> tuple[Neighbours, Links, DataFrame, DataFrame]:
    if params["n_dims"] != 2:
        raise ValueError("trimap places rows in two dimensions only")
    if params["opt_method"] not in ("dbd", "sd", "momentum"):
        raise ValueError(f"unknown opt_method {params['opt_method']!r}")
    base = reduced(df, params, 100)
    nb = neighbours(base, params["n_inliers"] + EXTRA, params["backend"], params["distance"], **neighbour_options(params))
    t = cut(triplets(nb, min(params["n_inliers"], nb.n - 1), params["n_outliers"], params["n_random"], params["weight_temp"], params["random_state"]))
    links = Links(t, nb.n, 32, ends=("i", "j", "k"))
    rate = params["lr"] * nb.n / max(t.count(), 1)
    start = cut(start_pca(nb))
    state = with_state(start, vx=0, vy=0, kx=1, ky=1, t=0)
    momentum = "(CASE WHEN t < 250D THEN 0.5D ELSE 0.8D END)"
    if links.fits_task(256, 256):
        return nb, links, start, trimap_here(links, state, rate, params["n_iters"], params["opt_method"])
    for _ in range(params["n_iters"]):
        if params["opt_method"] == "dbd":
            state = trimap_step(links, state, rate, momentum)
        else:
            plain = "0D" if params["opt_method"] == "sd" else momentum
            state = trimap_step(links, state.selectExpr("node", "x", "y", "vx", "vy", "1D AS kx", "1D AS ky", "t"), rate, plain)
    return nb, links, start, state


@method("trimap")
def trimap(df: DataFrame, params: dict) -> DataFrame:
    nb, links, _, state = fit_trimap(df, params)
    links.close()
    return nb.back(state.select("node", "x", "y"))


# --- SpaceMAP


def intrinsic_dimension(nb: Neighbours, k: int) -> DataFrame:
    """node, dim: the maximum-likelihood dimension from the first k neighbour distances."""
    near = nb.knn.filter((F.col("rank") <= k) & (F.col("dist") > 0))
    far = near.groupBy("src").agg(F.max("dist").alias("t"), F.count(F.lit(1)).alias("c"))
    logs = near.join(far, "src").groupBy("src").agg(F.sum(F.log(F.col("t") / F.col("dist"))).alias("s"), F.max("c").alias("c"))
    dim = F.when(F.col("s") > 0, (F.col("c") - 1) / F.col("s")).otherwise(F.lit(2.0))
    return logs.select(F.col("src").alias("node"), F.greatest(dim, F.lit(1.0)).alias("dim"))


def spacemap_fields(nb: Neighbours, near: int, middle: int, d_local: float, d_global: float) -> DataFrame:
    """src, dst, field, w: similarities of near and middle neighbours on expanded distances.

    A ball of radius r in d dimensions grows like r^d, in the plane like r^2: a
    distance becomes (d_ij / s_i)^(d / 2) with s_i the distance where the field
    starts. ``d_local`` 0 estimates the dimension per node.
    """
    dims = intrinsic_dimension(nb, near) if d_local == 0 else nb.nodes.select("node", F.lit(float(d_local)).alias("dim"))
    edge = nb.knn.filter(F.col("rank") == F.least(F.lit(near), F.lit(nb.n - 1))).select(F.col("src").alias("node"), F.greatest("dist", F.lit(1e-12)).alias("reach"))
    table = dims.join(edge, "node", "right").select("node", F.coalesce("dim", F.lit(2.0)).alias("dim"), "reach")
    links = Links(nb.knn.filter(F.col("rank") <= near + middle), nb.n, 32)
    e = links.attach(links.edges, "src", table)
    close = F.pow(F.col("dist") / F.col("reach"), F.col("dim") / 2)
    wide = F.pow(F.col("dist") / F.col("reach"), F.lit(d_global / 2))
    field = F.when(F.col("rank") <= near, "near").otherwise("middle")
    w = F.when(F.col("rank") <= near, F.exp(-close)).otherwise(F.exp(-wide))
    out = cut(e.select("src", "dst", field.alias("field"), w.alias("w")))
    links.close()
    return out


def fit_spacemap(df: DataFrame, params: dict) -> tuple[Neighbours, DataFrame]:
    near, middle, seed = params["n_near_field"], params["n_middle_field"], params["random_state"]
    nb = neighbours(df, near + middle, params["backend"], params["metric"], **neighbour_options(params))
    fields = spacemap_fields(nb, near, middle, params["d_local"], params["d_global"])
    # Near edges count fully, middle ones by (1 - eta).
    share = F.when(F.col("field") == "near", F.lit(float(params["eta"]))).otherwise(F.lit(1.0 - float(params["eta"])))
    edges = cut(symmetrise(fields.select("src", "dst", (F.col("w") * share).alias("w")), "mean"))
    if params["init"] == "spectral":
        start = umap_start(nb, edges, {"init": "spectral", "random_state": seed})
    else:
        start = start_random(nb, 5.0, seed)
    top = edges.agg(F.max("w")).first()[0] or 1.0
    links = Links(edges.select("src", "dst", (F.col("w") / top).alias("w")), nb.n, 32)
    deg = links.edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg"))
    state = cut(start.join(deg, "node", "left").select("node", "x", "y", F.coalesce("deg", F.lit(0.0)).alias("deg"), F.lit(0.0).alias("t")))
    curves = "2D / (1D + d2)", "2D / ((0.001D + d2) * (1D + d2))", lambda d2: 2.0 / (1.0 + d2), lambda d2: 2.0 / ((0.001 + d2) * (1.0 + d2))
    state = epochs_of(links, state, nb.n, params["n_epochs"], 1.0, curves, 5, seed)
    links.close()
    return nb, state


@method("spacemap")
def spacemap(df: DataFrame, params: dict) -> DataFrame:
    nb, state = fit_spacemap(df, params)
    return nb.back(state.select("node", "x", "y"))
