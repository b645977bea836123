"""Iterative layouts: pair tables, forces on both ends, and state updates as joins and sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planisphere.functions.seeded import normal, u01
from planisphere.functions.vectors import as_xy, distance, map_matrix
from planisphere.operators.graph import Links, Neighbours
from planisphere.operators.pairs import nth_neighbour
from planisphere.session import cut

# --- pair tables


def scaled_distances(nb: Neighbours) -> DataFrame:
    """src, dst, dist, scaled = d^2 / (s_i s_j), s the mean distance to neighbours four to six."""
    scale = nth_neighbour(nb.knn, 4, 6).withColumn("scale", F.greatest("scale", F.lit(1e-10)))
    links = Links(nb.knn.select("src", "dst", "dist"), nb.n, 24)
    s = scale.select(F.col("src").alias("node"), "scale")
    both = links.attach(links.attach(links.edges, "src", s, {"scale": "si"}), "dst", s, {"scale": "sj"})
    return both.select("src", "dst", "dist", (F.col("dist") * F.col("dist") / (F.col("si") * F.col("sj"))).alias("scaled"))


def near_pairs(nb: Neighbours, k: int) -> DataFrame:
    """src, rank, dst, scaled: the k nearest by scaled distance of the listed neighbours."""
    w = Window.partitionBy("src").orderBy("scaled", "dst")
    return scaled_distances(nb).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("src", "rank", "dst", "scaled")


def other_node(n: int, seed, *key):
    """A seeded node different from ``src``: the draw runs over the n - 1 others."""
    return F.pmod(F.col("src") + 1 + F.floor(u01(seed, F.col("src"), *key) * F.lit(n - 1)).cast("bigint"), F.lit(n))


def with_distance(nb: Neighbours, pairs: DataFrame, end: str = "dst", out: str = "dist") -> DataFrame:
    """Pairs (src, ``end``) with the distance of their vectors."""
    e = nb.nodes.select("node", "embedding")
    a = e.select(F.col("node").alias("src"), F.col("embedding").alias("_a"))
    b = e.select(F.col("node").alias(end), F.col("embedding").alias("_b"))
    return pairs.join(b, end).join(a, "src").withColumn(out, distance(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def mid_pairs(nb: Neighbours, per_node: int, seed) -> DataFrame:
    """src, slot, dst: per slot the second closest of six random nodes."""
    drawn = nb.nodes.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("slot")).withColumn(
        "t", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("dst", other_node(nb.n, seed, F.col("slot"), F.col("t")))
    w = Window.partitionBy("src", "slot").orderBy("dist", "dst", "t")
    return with_distance(nb, drawn).withColumn("r", F.row_number().over(w)).filter(F.col("r") == 2).select("src", "slot", "dst")


def both_ways(pairs: DataFrame, *columns: str) -> DataFrame:
    """Every pair from both of its ends, so that one sum per source is the whole gradient."""
    return pairs.select("src", "dst", *columns).unionByName(
        pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns))


# --- starts


def start_pca(nb: Neighbours, scale: float = 0.01) -> DataFrame:
    from planisphere.methods.linear import fit_pca

    model = fit_pca(nb.nodes)
    spread = float(np.sqrt(max(model.values[0], 1e-300)))
    rows = map_matrix(nb.nodes.select("node", "embedding"), "embedding", lambda x: model.apply(x) / spread * scale)
    return as_xy(rows)


def start_random(nb: Neighbours, scale: float, seed) -> DataFrame:
    node = F.col("node")
    return nb.nodes.select("node", (normal(seed, node, "x") * scale).alias("x"), (normal(seed, node, "y") * scale).alias("y"))


# --- forces


def messages(links: Links, state: DataFrame, coef: str, also: list[str] = (), own: list[str] = ()) -> DataFrame:
    """Per edge the pull coef * (y_src - y_dst) on its source: node, gx, gy.

    ``coef`` is SQL over the edge columns, the ``own`` columns of the source and d2, the squared distance of the ends.
    """
    e = links.attach(links.edges, "dst", state, {"x": "xj", "y": "yj"}, list(also))
    e = links.attach(e, "src", state, {"x": "xi", "y": "yi", **{c: c for c in own}}, list(also))
    e = e.selectExpr("*", "xi - xj AS dx", "yi - yj AS dy").selectExpr("*", "dx * dx + dy * dy AS d2")
    return e.selectExpr("src AS node", *also, f"({coef}) AS c", "dx", "dy").selectExpr("node", *also, "c * dx AS gx", "c * dy AS gy")


def gather(*parts: DataFrame) -> DataFrame:
    """Sum of all pulls per node; partial sums form before the shuffle."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    keys = [c for c in whole.columns if c not in ("gx", "gy")]
    return whole.groupBy(*keys).agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))


def moved(links: Links, state: DataFrame, coef: str) -> DataFrame:
    """The state with gx, gy: the sum of ``coef`` * (y_src - y_dst) over the edges of every node.

    ``coef`` is SQL over the edge columns, d2 and the columns of the source's state. Where node tables are
    broadcast, the edges stay where they are and one narrow pass does it all; a state with a ``t`` column
    keeps the SQL of all steps the same, so it is compiled once. Else the edges meet their ends by shuffle.
    """
    columns = state.columns
    if not links.small:
        pulls = gather(messages(links, state, coef, own=[c for c in columns if c not in ("node", "x", "y")]))
        return state.join(pulls, "node", "left").selectExpr(*columns, "coalesce(gx, 0D) AS gx", "coalesce(gy, 0D) AS gy")
    own = state.select(F.col("node").alias("src"), F.struct(*columns).alias("own"))
    other = state.selectExpr("node AS dst", "x AS xj", "y AS yj")
    e = links.by_source(state).join(F.broadcast(own), "src").join(F.broadcast(other), "dst")
    e = e.selectExpr("*", *[f"own.{c} AS {c}" for c in columns if c not in ("node", "x", "y")], "own.x - xj AS dx", "own.y - yj AS dy").selectExpr("*", "dx * dx + dy * dy AS d2")
    e = e.selectExpr("src", "own", f"CASE WHEN src = dst THEN 0D ELSE {coef} END AS c", "dx", "dy")
    return e.groupBy("src").agg(F.first("own").alias("own"), F.expr("sum(c * dx) AS gx"), F.expr("sum(c * dy) AS gy")).selectExpr("own.*", "gx", "gy")


def update(pulled: DataFrame, new: dict[str, str], replaces: DataFrame | None = None) -> DataFrame:
    """The next state: SQL of the changed columns over the state and its gradient gx, gy."""
    columns = [c for c in pulled.columns if c not in ("gx", "gy")]
    return cut(pulled.selectExpr(*[f"{new[c]} AS {c}" if c in new else c for c in columns]), replaces=replaces)


def step(state: DataFrame, pulls: DataFrame, keys: list[str], new: dict[str, str]) -> DataFrame:
    """:func:`update` for pulls that come as a table of their own."""
    joined = state.join(pulls, keys, "left").selectExpr(
        *state.columns, "coalesce(gx, 0D) AS gx", "coalesce(gy, 0D) AS gy")
    return update(joined, new, state)


def with_state(start: DataFrame, **columns: float) -> DataFrame:
    return cut(start.select("*", *[F.lit(float(v)).alias(c) for c, v in columns.items()]))


def adam(rate: float) -> dict[str, str]:
    """One update of x and y with running moments mx, my, vx, vy; ``t`` counts the steps from 0."""
    out = {"t": "t + 1D"}
    for c in "xy":
        m, v = f"(0.9D * m{c} + 0.1D * g{c})", f"(0.999D * v{c} + 0.001D * g{c} * g{c})"
        out[f"m{c}"], out[f"v{c}"] = m, v
        out[c] = f"{c} - {rate!r}D * ({m} / (1D - pow(0.9D, t + 1D))) / (sqrt({v} / (1D - pow(0.999D, t + 1D))) + 1e-7D)"
    return out


def delta_bar_delta(rate: float, momentum: str) -> dict[str, str]:
    """Gains grow by 0.2 where gradient and velocity disagree and shrink by 0.8 elsewhere; ``momentum``: SQL over t."""
    out = {"t": "t + 1D"}
    for c in "xy":
        gain = f"greatest(CASE WHEN sign(g{c}) <> sign(v{c}) THEN k{c} + 0.2D ELSE k{c} * 0.8D END, 0.01D)"
        velocity = f"({momentum} * v{c} - {rate!r}D * {gain} * g{c})"
        out[f"k{c}"], out[f"v{c}"], out[c] = gain, velocity, f"{c} + {velocity}"
    return out


# --- repulsion of all points on a grid


@dataclass
class Grid:
    """Fields of the kernels q and q^2 over a square, read back by bilinear weights."""

    low: np.ndarray
    size: float
    fields: np.ndarray  # particle, (q, q2, q2 x, q2 y), m, m

    @property
    def m(self) -> int:
        return self.fields.shape[-1]

    def read(self, x: np.ndarray, y: np.ndarray, particle: np.ndarray) -> np.ndarray:
        u, v = (x - self.low[0]) / self.size, (y - self.low[1]) / self.size
        i, j = np.clip(u.astype(int), 0, self.m - 2), np.clip(v.astype(int), 0, self.m - 2)
        fu, fv = u - i, v - j
        out = np.zeros((len(x), 4))
        for a, wa in ((0, 1 - fu), (1, fu)):
            for b, wb in ((0, 1 - fv), (1, fv)):
                out += (wa * wb)[:, None] * self.fields[particle, :, i + a, j + b]
        return out


#: Cells whose sums reach the driver at once.
CELLS = 1 << 20


def repulsion_grid(state: DataFrame, particles: int = 1, cell: float = 0.5, least: int = 48, most: int = 1024) -> tuple[Grid, np.ndarray]:
    """The grid and, per particle, the sum of q over all ordered pairs (self pairs included).

    Points meet on at most particles * most^2 cells, whose sums reach the driver;
    the convolution with both kernels is a transform of that fixed size.
    """
    b = state.selectExpr("min(x)", "max(x)", "min(y)", "max(y)").first()
    low, h, m = grid_over(*b, cell, least, most)
    part = "particle" if "particle" in state.columns else "0"
    x0, y0, side = float(low[0]), float(low[1]), float(h)
    placed = state.selectExpr(f"{part} AS p", f"(x - ({x0!r}D)) / {side!r}D AS u", f"(y - ({y0!r}D)) / {side!r}D AS v", "x", "y")
    cells = placed.selectExpr("p", "x", "y", "cast(floor(u) AS int) AS i", "cast(floor(v) AS int) AS j", "u - floor(u) AS fu", "v - floor(v) AS fv")
    corner = "named_struct('ci', i + {0}, 'cj', j + {1}, 'w', {2} * {3})"
    whole = [corner.format(a, b, fu, fv) for a, fu in ((0, "(1 - fu)"), (1, "fu")) for b, fv in ((0, "(1 - fv)"), (1, "fv"))]
    corners = cells.selectExpr("p", "x", "y", f"inline(array({', '.join(whole)}))")
    summed = corners.groupBy("p", "ci", "cj").agg(F.sum("w").alias("w"), F.expr("sum(w * x)").alias("wx"), F.expr("sum(w * y)").alias("wy"))
    fields, total = np.zeros((particles, 4, m, m)), np.zeros(particles)
    # As columns, and of so many particles at once that the driver never holds more than CELLS rows.
    few = max(CELLS // (m * m), 1)
    for first in range(0, particles, few):
        last = min(first + few, particles)
        part_of = summed if few >= particles else summed.filter(F.col("p").between(first, last - 1))
        rows = {c: v.to_numpy() for c, v in zip(summed.columns, part_of.toArrow().columns)}
        at = rows["p"] - first, np.minimum(rows["ci"], m - 1), np.minimum(rows["cj"], m - 1)
        mass = np.zeros((last - first, 3, m, m))
        for c, name in enumerate(("w", "wx", "wy")):
            mass[at[0], c, at[1], at[2]] = rows[name]
        grid, total[first:last] = grid_of(low, h, mass)
        fields[first:last] = grid.fields
    return Grid(low, h, fields), total


def grid_over(left: float, right: float, bottom: float, top: float, cell: float = 0.5, least: int = 48, most: int = 1024) -> tuple[np.ndarray, float, int]:
    """Corner, side of a cell and cells per side of the square grid over an extent."""
    width = max(right - left, top - bottom, 1e-12) * 1.0001
    m = int(np.clip(np.ceil(width / cell), least, most))
    return np.array([left, bottom], dtype=float), width / (m - 1), m


def grid_of(low: np.ndarray, h: float, mass: np.ndarray) -> tuple[Grid, np.ndarray]:
    """The fields of the summed weights (particle, 3, m, m), and the pair sums of q."""
    particles, m = len(mass), mass.shape[-1]
    ax = np.arange(2 * m)
    gap = np.where(ax < m, ax, ax - 2 * m) * h
    q = 1.0 / (1.0 + gap[:, None] ** 2 + gap[None, :] ** 2)
    fq, fq2 = np.fft.rfft2(q), np.fft.rfft2(q * q)
    fields = np.zeros((particles, 4, m, m))
    for p in range(particles):
        f = [np.fft.rfft2(mass[p, c], s=(2 * m, 2 * m)) for c in range(3)]
        for c, (k, g) in enumerate(((fq, f[0]), (fq2, f[0]), (fq2, f[1]), (fq2, f[2]))):
            fields[p, c] = np.fft.irfft2(k * g, s=(2 * m, 2 * m))[:m, :m]
    total = (fields[:, 0] * mass[:, 0]).sum(axis=(1, 2))
    return Grid(low, float(h), fields), total


def grid_here(x: np.ndarray, y: np.ndarray) -> tuple[Grid, float]:
    """:func:`repulsion_grid` of points held here."""
    low, h, m = grid_over(x.min(), x.max(), y.min(), y.max())
    u, v = (x - low[0]) / h, (y - low[1]) / h
    i, j = np.floor(u).astype(int), np.floor(v).astype(int)
    fu, fv = u - i, v - j
    mass = np.zeros((1, 3, m * m))
    for a, wu in ((0, 1 - fu), (1, fu)):
        for b, wv in ((0, 1 - fv), (1, fv)):
            at, w = np.minimum(i + a, m - 1) * m + np.minimum(j + b, m - 1), wu * wv
            for c, value in enumerate((w, w * x, w * y)):
                mass[0, c] += np.bincount(at, value, m * m)
    grid, total = grid_of(low, h, mass.reshape(1, 3, m, m))
    return grid, float(total[0])


def read_repulsion(state: DataFrame, grid: Grid) -> DataFrame:
    """Keys, rx, ry: the sum over all points of q^2 (y_i - y_j)."""
    keys = ["node"] + (["particle"] if "particle" in state.columns else [])

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            p = batch.column(3).to_numpy() if batch.num_columns > 3 else np.zeros(len(x), int)
            f = grid.read(x, y, p)
            arrays = [*[batch.column(i) for i in range(2, batch.num_columns)], pa.array(x * f[:, 1] - f[:, 2]), pa.array(y * f[:, 1] - f[:, 3])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "rx", "ry"])

    kinds = "node bigint, " + ("particle int, " if len(keys) > 1 else "")
    return state.select("x", "y", *keys).mapInArrow(run, kinds + "rx double, ry double")


def take_repulsion(pulled: DataFrame, grid: Grid, share: float) -> DataFrame:
    """``pulled`` with ``share`` times the repulsion read from the grid taken off gx and gy; rows stay where they are."""
    names = pulled.columns

    def run(batches):
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            x, y, gx, gy = (columns[c].to_numpy(zero_copy_only=False) for c in ("x", "y", "gx", "gy"))
            f = grid.read(x, y, np.zeros(len(x), int))
            columns["gx"], columns["gy"] = pa.array(gx - share * (x * f[:, 1] - f[:, 2])), pa.array(gy - share * (y * f[:, 1] - f[:, 3]))
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return pulled.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in pulled.dtypes))
