"""Sparse graphs as edge tables: look-ups, components, geodesics and eigenvectors."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planisphere.functions.seeded import normal
from planisphere.functions.skew import add_salt, hot_keys, repeat_for_salt, salted_join
from planisphere.functions.vectors import to_matrix
from planisphere.operators.knn import knn, knn_exact
from planisphere.operators.moments import sum_arrays
from planisphere.operators.pairs import number_nodes
from planisphere.session import BROADCAST_BYTES, arrow_rows, cut


EDGES_PER_TASK = 65536
#: Bytes of the Arrow batches of wide rows; a worker holds a few copies of one.
WIDE_BATCH = 8 * 1024 * 1024
#: Bytes of a graph and its nodes' values that one task may work on by itself.
TASK_BYTES = 128 * 1024 * 1024


class Links:
    """An edge table prepared for repeated look-ups of node values at both ends.

    Node tables of a checked small size are broadcast. Beyond that both ends get a
    salt once, so that a node with a large share of all edges is spread over many
    tasks, and every look-up is a shuffle join on (end, salt).
    """

    def __init__(self, edges: DataFrame, n: int, row_bytes: int = 32, limit: int | None = None, ends: tuple[str, ...] = ("src", "dst")):
        self.bounded = limit is not None
        limit = BROADCAST_BYTES if limit is None else limit
        self._rows = None
        self.n, self.limit, self.row_bytes, self.hot, self.ends, self._by_source = n, limit, row_bytes, {}, ends, None
        self.small = n * row_bytes <= limit
        if not self.small:
            base = edges.persist()
            rows = base.count()
            for end in ends:
                self.hot[end] = cut(hot_keys(base, end, rows))
                edges = add_salt(edges, end, self.hot[end], *[e for e in ends if e != end]).withColumnRenamed("_salt", f"_salt_{end}")
        table = cut(edges)
        if not self.small:
            # Stored by its last end: the first look-up, which starts there, moves only the node values.
            last = ends[-1]
            parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            table = table.repartition(parts, F.col(last), F.col(f"_salt_{last}"))
            base.unpersist()
        self.edges = table.persist()
        if not self.small:
            # The stored partitioning is known to later plans only once the table is filled.
            self.edges.count()

    def fits_task(self, node_bytes: int, edge_bytes: int = 128) -> bool:
        """Whether one task can hold all edges and ``node_bytes`` per node, steps and copies included; no for links with a limit of their own."""
        if self.bounded or not self.small or self.n * node_bytes > TASK_BYTES:
            return False
        if self._rows is None:
            self._rows = self.edges.count()
        return self.n * node_bytes + self._rows * edge_bytes <= TASK_BYTES

    def attach(self, df: DataFrame, end: str, values: DataFrame, names: dict[str, str] | None = None, also: list[str] = ()) -> DataFrame:
        """``df`` with the columns of ``values`` (one row per node) of the node at ``end``."""
        names = names or {c: c for c in values.columns if c not in ("node", *also)}
        v = values.select(F.col("node").alias(end), *also, *[F.col(c).alias(a) for c, a in names.items()])
        # The first look-up of several rows per node brings their key, the later ones match it.
        shared = [c for c in also if c in df.columns]
        if self.small:
            return df.join(F.broadcast(v), [end, *shared])
        v = repeat_for_salt(v, end, self.hot[end]).withColumnRenamed("_salt", f"_salt_{end}")
        return df.join(v, [end, f"_salt_{end}", *shared])

    def by_source(self, state: DataFrame) -> DataFrame:
        """The edges stored by their first end, and an edge of every node to itself with null columns.

        A step that looks both ends up in a broadcast table then sums per node without moving an edge;
        the edge to itself brings nodes along that have no other.
        """
        if self._by_source is None:
            src, dst = self.ends[:2]
            rest = [c for c in self.edges.columns if c not in (src, dst)]
            own = state.select(F.col("node").alias(src), F.col("node").alias(dst)).distinct()
            kinds = dict(self.edges.dtypes)
            whole = self.edges.unionByName(own.select(src, dst, *[F.lit(None).cast(kinds[c]).alias(c) for c in rest]))
            parts = max(-(-self.edges.count() // EDGES_PER_TASK), 1)
            self._by_source = whole.repartition(parts, src).sortWithinPartitions(src).persist()
            self._by_source.count()  # the stored partitioning is known to later plans only once the table is filled
        return self._by_source

    def close(self) -> None:
        self.edges.unpersist()
        if self._by_source is not None:
            self._by_source.unpersist()


@dataclass
class Neighbours:
    """Numbered nodes, their count, and the directed k-neighbour table src, rank, dst, dist."""

    nodes: DataFrame
    n: int
    knn: DataFrame
    metric: str = "euclidean"

    def back(self, coords: DataFrame) -> DataFrame:
        """item_id, group_key, x, y from node, x, y."""
        return self.nodes.select("node", "item_id", "group_key").join(coords, "node").select("item_id", "group_key", "x", "y")


@dataclass
class _Shared:
    """Neighbour joins made so far, and a lock per join so that of several threads one makes it."""

    made: dict
    locks: dict
    lock: threading.Lock


_SHARED: ContextVar[_Shared | None] = ContextVar("shared_neighbours", default=None)


@contextmanager
def share_neighbours():
    """Inside the block, neighbour joins over one and the same table are made once.

    A join asked for again with no more neighbours than before reads the stored one.
    """
    token = _SHARED.set(_Shared({}, {}, threading.Lock()))
    try:
        yield
    finally:
        _SHARED.reset(token)


def neighbours(df: DataFrame, k: int, backend: str = "exact", metric: str = "euclidean", include_self: bool = False, **options) -> Neighbours:
    """The numbered rows and their k nearest; ``options`` go to the backend's join."""
    shared = _SHARED.get()
    if shared is None:
        return _neighbours(df, k, backend, metric, include_self, options)
    key = (id(df), backend, metric, include_self, tuple(sorted(options.items())))
    with shared.lock:
        mine = shared.locks.setdefault(key, threading.Lock())
    with mine:
        if key not in shared.made or shared.made[key][1] < k:
            # The table itself is kept with the entry, so its id stays taken.
            shared.made[key] = (df, k, _neighbours(df, k, backend, metric, include_self, options))
        nb = shared.made[key][2]
    return replace(nb, knn=nb.knn.filter(F.col("rank") <= k))


def _neighbours(df: DataFrame, k: int, backend: str, metric: str, include_self: bool, options: dict) -> Neighbours:
    nodes = number_nodes(df.select("item_id", "group_key", "embedding"))
    n = nodes.count()
    most = min(k, max(n - 1, 1))
    return Neighbours(nodes, n, cut(knn(nodes, most, backend, key="node", metric=metric, include_self=include_self, **options)), metric)


# --- connected components

def components(links: Links, nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """node, comp with the smallest node of each component.

    Labels travel over the edges and then jump to the label of their label, which
    keeps the rounds near the logarithm of the longest path. Edges must be stored
    in both directions.
    """
    labels = cut(nodes.select("node", F.col("node").alias("comp")))
    for _ in range(rounds):
        heard = links.attach(links.edges, "dst", labels).groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("c"))
        near = cut(labels.join(heard, "node", "left").select("node", "comp", F.least("comp", F.coalesce("c", "comp")).alias("c")))
        # The label of a label. Many nodes may share one, so that side is salted where it is not broadcast.
        to = near.select(F.col("node").alias("c"), F.col("c").alias("to"))
        moved = near.join(F.broadcast(to), "c") if links.small else salted_join(near, to, "c", links.n, "node")
        after = cut(moved.select("node", F.least("c", "to").alias("comp"), (F.least("c", "to") != F.col("comp")).alias("changed")), replaces=near)
        done = after.filter("changed").isEmpty()
        labels = after.select("node", "comp")
        if done:
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")


def connect(nb: Neighbours, edges: DataFrame, weight: str = "w", close: Column | None = None) -> DataFrame:
    """Edges (both directions) plus the shortest link of every component but the largest to another one, until all is one.

    Every round at least halves the number of components, and only rows outside the largest one ask for
    neighbours, by the metric of the graph. ``close`` turns ``dist`` into the weight of an added edge; the
    distance itself is the default.
    """
    while True:
        links = Links(edges, nb.n)
        comp = components(links, nb.nodes)
        links.close()
        if comp.agg(F.max("comp")).first()[0] in (None, 0):
            return edges
        largest = comp.groupBy("comp").count().agg(F.max_by("comp", F.struct("count", -F.col("comp")))).first()[0]
        tagged = nb.nodes.select("node", "embedding").join(comp, "node")
        outward = knn_exact(tagged, 1, key="node", tag="comp", metric=nb.metric, n=nb.n, only=comp.filter(F.col("comp") != largest)).join(comp, F.col("src") == F.col("node"))
        best = outward.groupBy("comp").agg(F.min_by(F.struct("src", "dst", "dist"), F.struct("dist", "src", "dst")).alias("b"))
        added = best.select("b.src", "b.dst", F.col("b.dist").alias("dist")).withColumn(weight, F.col("dist") if close is None else close)
        both = added.select("src", "dst", weight).unionByName(added.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight)).distinct()
        edges = cut(edges.select("src", "dst", weight).unionByName(both))


# --- shortest paths

def geodesics(links: Links, sources: list[int], weight: str = "w", rounds: int = 10000, plain: int = 12, degree: int = 12) -> DataFrame:
    """node, mark, dist: shortest path length from every source to every reached node.

    Only pairs that improved in the last round are sent on; it ends when none did. Where ``plain`` rounds do not
    settle the paths, the graph has long chains of nodes: it is contracted first (:func:`contract`), the paths are
    settled on what is left, and the contracted nodes then read their distance from their neighbours, level by level.
    The rounds grow with the logarithm of the length of a chain, and every distance stays exact.
    """
    start = links.edges.sparkSession.createDataFrame([(s, m, 0.0) for m, s in enumerate(sources)], "node bigint, mark int, dist double")
    known, settled = relax(links, start, weight, min(plain, rounds))
    if settled:
        return known
    core, levels = contract(links.edges.select("src", "dst", F.col(weight).alias("w")), sources, degree)
    for gone in levels:
        # Distances so far are lengths of real paths; those of nodes that stay save the first rounds.
        known = known.join(gone, "node", "left_anti")
    left = Links(core, links.n, links.row_bytes, links.limit)
    known, settled = relax(left, known, "w", rounds)
    left.close()
    if not settled:
        raise RuntimeError(f"paths not settled after {rounds} rounds")
    for inward in reversed(levels):
        near = inward.select("node", F.explode("inward").alias("e")).select("node", F.col("e.src").alias("src"), F.col("e.w").alias("w"))
        front = known.groupBy(F.col("node").alias("src")).agg(F.collect_list(F.struct("mark", "dist")).alias("front"))
        met = near.join(F.broadcast(front), "src") if links.small else salted_join(near, front, "src", links.n, "node")
        told = met.select("node", "w", F.explode("front").alias("f")).groupBy("node", F.col("f.mark").alias("mark"))
        known = cut(known.unionByName(told.agg(F.min(F.col("f.dist") + F.col("w")).alias("dist"))), replaces=known)
    return known


def relax(links: Links, start: DataFrame, weight: str, rounds: int) -> tuple[DataFrame, bool]:
    """node, mark, dist after at most ``rounds`` rounds over all edges, and whether nothing can improve any more."""
    known = cut(start.select("node", "mark", "dist", F.lit(True).alias("changed")))
    for _ in range(rounds):
        front = known.filter("changed").groupBy("node").agg(F.collect_list(F.struct("mark", "dist")).alias("front"))
        # A list holds at most one entry per source.
        sent = links.attach(links.edges, "src", front).select(
            F.col("dst").alias("node"), F.explode("front").alias("f"), F.col(weight).alias("step"))
        offer = sent.groupBy("node", F.col("f.mark").alias("mark")).agg(F.min(F.col("f.dist") + F.col("step")).alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))
        known = cut(known.join(offer, ["node", "mark"], "full").select(
            "node", "mark", F.when(better, F.col("offer")).otherwise(F.col("dist")).alias("dist"), better.alias("changed")), replaces=known)
        if known.filter("changed").isEmpty():
            return _plain(known), True
    return _plain(known), False


def _plain(known: DataFrame) -> DataFrame:
    out = known.select("node", "mark", "dist")
    out._cut_folder = known._cut_folder
    return out


def contract(edges: DataFrame, keep: list[int], degree: int = 12, least: float = 1 / 16, most: float = 2.0) -> tuple[DataFrame, list[DataFrame]]:
    """Edges src, dst, w of a smaller graph with the same distances between its nodes, and the nodes taken out per level.

    A level takes out nodes with at most ``degree`` edges in and out of which no two are neighbours, chosen by a
    keyed hash; an edge into such a node and one out of it become one edge past it, and only the shortest of
    parallel edges stays. The nodes of a level come as ``node, inward`` with their edges inward, at most ``degree``.
    Nodes in ``keep`` stay. It ends where fewer than ``least`` of the nodes go or the edges would be more than
    ``most`` times those given, as in graphs without chains.
    """
    def tidy(e):
        return e.filter("src != dst").groupBy("src", "dst").agg(F.min("w").alias("w"))

    edges = cut(tidy(edges))
    first = rows = edges.count()
    levels: list[DataFrame] = []
    while rows:
        ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
            edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        nodes = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        turn = F.struct(F.xxhash64(F.lit(len(levels)), F.col("node")), F.col("node"))
        slim = cut(nodes.select("node", ((F.col("o") <= degree) & (F.col("i") <= degree) & ~F.col("node").isin(keep)).alias("slim"), turn.alias("turn")))
        able = slim.filter("slim").select("node", "turn")
        # Of two neighbours the one whose turn comes later is beaten.
        pair = salted_join(edges, able.toDF("src", "ts"), "src", rows, "dst")
        pair = salted_join(pair, able.toDF("dst", "td"), "dst", rows, "src")
        beaten = pair.select(F.when(F.col("ts") > F.col("td"), F.col("src")).otherwise(F.col("dst")).alias("node")).distinct()
        taken = cut(able.select("node").join(beaten, "node", "left_anti"))
        count, gone = slim.count(), taken.count()
        if gone < least * count:
            return edges, levels
        out = salted_join(edges, taken.select(F.col("node").alias("src"), F.lit(True).alias("leaves")), "src", rows, "dst", how="left")
        out = salted_join(out, taken.select(F.col("node").alias("dst"), F.lit(True).alias("enters")), "dst", rows, "src", how="left")
        tagged = cut(out)
        inward = tagged.filter("enters").groupBy(F.col("dst").alias("node")).agg(F.collect_list(F.struct("src", "w")).alias("inward"))
        inward = cut(taken.join(inward, "node", "left"))
        passing = inward.select("node", F.explode("inward").alias("a")).join(tagged.filter("leaves").select(F.col("src").alias("node"), "dst", F.col("w").alias("rest")), "node")
        passing = passing.select(F.col("a.src").alias("src"), "dst", (F.col("a.w") + F.col("rest")).alias("w"))
        after = cut(tidy(tagged.filter(F.col("leaves").isNull() & F.col("enters").isNull()).select("src", "dst", "w").unionByName(passing)))
        rows = after.count()
        if rows > most * first:
            return edges, levels
        levels.append(inward)
        edges = after
    return edges, levels


# --- eigenvectors

#: Vectors carried beside the wanted ones. A flat spectrum, where the next values are close, needs many.
EXTRA_VECTORS = 22


@dataclass
class Eigen:
    """Eigenvalues, their vectors as node, v0, v1.., and the residual norms over the spectral norm."""

    values: np.ndarray
    vectors: DataFrame
    residuals: np.ndarray

    def converged(self, tol: float) -> bool:
        return bool((self.residuals <= tol).all())


def product(links: Links, values: DataFrame, m: int, weight: str = "w", frm: str = "dst", to: str = "src") -> DataFrame:
    """Sparse matrix times block: node, a0.. with a = sum of weight * v over the edges of ``to``."""
    sent = links.attach(links.edges, frm, values, {f"v{i}": f"v{i}" for i in range(m)})
    sums = [F.expr(f"sum({weight} * v{i}) AS a{i}") for i in range(m)]
    return sent.groupBy(F.col(to).alias("node")).agg(*sums)


def eigenvectors(nodes: DataFrame, multiply, k: int, low: float, high: float, largest: bool, known: DataFrame | None = None,
                 extra: int = EXTRA_VECTORS, steps: int = 10, max_iter: int = 60, tol: float = 1e-4, seed: int = 42,
                 links: Links | None = None, here=None) -> Eigen:
    """The k outermost eigenpairs of a symmetric sparse operator with spectrum inside [low, high].

    ``multiply(df, m)`` maps node, v0.. to node, a0... A block of k + extra vectors is
    expanded by a Chebyshev recurrence, which needs no dot products, so a cycle of
    ``steps`` products ends with one small Gram aggregate; the projected problem is
    solved on the driver and the best vectors start the next cycle. ``known`` holds
    a known eigenvector (node, u) that is kept out. Where the graph of ``links`` fits one task, the same cycles run there:
    ``here(edges, block)`` multiplies a numpy block by the operator.
    """
    m, has_known = k + extra, known is not None
    state = nodes.select("node", *[normal(seed, F.col("node"), c).alias(f"b0_{c}") for c in range(m)])
    state = cut(state.join(known, "node") if has_known else state)
    lead = ["u"] if has_known else []
    if here is not None and links.fits_task(2 * 8 * ((steps + 1) * m + 1)):
        return _in_one_task(links, here, state, k, m, low, high, largest, has_known, steps, max_iter, tol)
    done = 0
    while True:
        scale, mid = (high - low) / 2.0, (high + low) / 2.0
        for s in range(steps):
            # b1 = A'b0, then 2 A'b - the one before, with A' = (A - mid) / scale.
            got = multiply(state.selectExpr("node", *[f"b{s}_{i} AS v{i}" for i in range(m)]), m)
            image = [f"(coalesce(a{i}, 0D) - {mid!r}D * b{s}_{i}) / {scale!r}D" for i in range(m)]
            new = [e if s == 0 else f"2D * ({e}) - b{s - 1}_{i}" for i, e in enumerate(image)]
            state = cut(state.join(got, "node", "left").selectExpr(
                *state.columns, *[f"{e} AS b{s + 1}_{i}" for i, e in enumerate(new)]), replaces=state)
            done += 1
        cols = [*lead, *[f"b{s}_{i}" for s in range(steps + 1) for i in range(m)]]
        with arrow_rows(state.sparkSession, 8 * len(cols), WIDE_BATCH):
            g = sum_arrays(state.select(*cols), _gram)[0]
        coef, theta, resid = _ritz(g, m, steps, has_known, largest, m)
        values = mid + scale * theta
        fresh = ["node", *[f"b0_{i}" for i in range(m)], *lead]
        with arrow_rows(state.sparkSession, 8 * len(cols), WIDE_BATCH):
            state = cut(state.select("node", *cols).mapInArrow(
                _rotate(coef, fresh), ", ".join(f"{c} {'bigint' if c == 'node' else 'double'}" for c in fresh)))
        norm = max(abs(high), abs(low), 1e-300)
        best = Eigen(values[:k], state.selectExpr("node", *[f"b0_{i} AS v{i}" for i in range(k)]), resid[:k] * scale / norm)
        if best.converged(tol) or done >= max_iter:
            return best
        if not largest and done == steps:
            # The random start of the first cycle sees the whole spectrum, so its top bounds it more tightly.
            _, top, over = _ritz(g, m, steps, has_known, True, 1)
            high = min(high, float(mid + scale * (top[0] + over[0])))


def _in_one_task(links: Links, here, state: DataFrame, k: int, m: int, low: float, high: float, largest: bool, has_known: bool, steps: int, max_iter: int, tol: float) -> Eigen:
    """The cycles of :func:`eigenvectors` on numpy blocks."""
    from planisphere.operators.one_task import in_one_task

    def run(edges, nodes):
        top, done = high, 0
        block = np.column_stack([nodes[f"b0_{c}"] for c in range(m)])
        while True:
            scale, mid = (top - low) / 2.0, (top + low) / 2.0
            blocks = [block]
            for s in range(steps):
                image = (here(edges, blocks[-1]) - mid * blocks[-1]) / scale
                blocks.append(image if s == 0 else 2.0 * image - blocks[-2])
            done += steps
            x = np.hstack([*([nodes["u"][:, None]] if has_known else []), *blocks])
            g = x.T @ x
            coef, theta, resid = _ritz(g, m, steps, has_known, largest, m)
            block, resid = x @ coef, resid[:k] * scale / max(abs(top), abs(low), 1e-300)
            if (resid <= tol).all() or done >= max_iter:
                break
            if not largest and done == steps:
                _, upper, over = _ritz(g, m, steps, has_known, True, 1)
                top = min(top, float(mid + scale * (upper[0] + over[0])))
        found = [np.concatenate([(mid + scale * theta)[:k], resid])] + [None] * (len(block) - 1)
        return {"node": nodes["node"], **{f"v{i}": block[:, i] for i in range(k)}, "found": pa.array(found, pa.list_(pa.float64()))}

    made = in_one_task(links, state, run, "node bigint, " + ", ".join(f"v{i} double" for i in range(k)) + ", found array<double>")
    found = np.array(made.filter("found IS NOT NULL").first()["found"])
    return Eigen(found[:k], made.drop("found"), found[k:])


def _matrix(batch, first: int = 0) -> np.ndarray:
    """The numeric columns of a batch side by side."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(first, batch.num_columns)])


def _gram(batch) -> list[np.ndarray]:
    x = _matrix(batch)
    return [x.T @ x]


def _rotate(coef: np.ndarray, names: list[str]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                new = _matrix(batch, 1) @ coef
                arrays = [batch.column(0), *[pa.array(new[:, i]) for i in range(new.shape[1])]]
                arrays += [batch.column(1)] * (len(names) - len(arrays))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _basis(g: np.ndarray, m: int, steps: int, has_known: bool):
    """Gram of the first ``steps`` blocks and of their images, with the known vector projected out."""
    if has_known:
        u, rest = g[0, 1:], g[1:, 1:]
        g = rest - np.outer(u, u) / g[0, 0]
    q = m * steps
    # A'b0 = b1 and A'bs = (b(s+1) + b(s-1)) / 2: the image of block s in the basis of steps + 1 blocks.
    t = np.zeros((m * (steps + 1), q))
    for s in range(steps):
        at = slice(s * m, (s + 1) * m)
        up = slice((s + 1) * m, (s + 2) * m)
        if s == 0:
            t[up, at] = np.eye(m)
        else:
            t[up, at] = np.eye(m) / 2
            t[slice((s - 1) * m, s * m), at] = np.eye(m) / 2
    return g, t, q


def _whiten(g: np.ndarray, t: np.ndarray, q: int):
    d = np.sqrt(np.maximum(np.diag(g)[:q], 1e-300))
    values, vectors = np.linalg.eigh(g[:q, :q] / np.outer(d, d))
    ok = values > 1e-12 * values.max()
    return (vectors[:, ok] / np.sqrt(values[ok])) / d[:, None]


def _ritz(g, m, steps, has_known, largest, count):
    full = g
    g, t, q = _basis(g, m, steps, has_known)
    p = _whiten(g, t, q)
    h = p.T @ (g[:q] @ t) @ p
    theta, y = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-theta if largest else theta)[:count]
    theta, c = theta[order], p @ y[:, order]
    image = t @ c
    padded = np.vstack([c, np.zeros((m, c.shape[1]))])
    diff = image - padded * theta
    resid = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", diff, g, diff), 0.0))
    if c.shape[1] < count:
        fill = count - c.shape[1]
        c = np.hstack([c, np.zeros((q, fill))])
        theta = np.append(theta, np.full(fill, theta[-1]))
        resid = np.append(resid, np.zeros(fill))
    c = np.vstack([c, np.zeros((m, c.shape[1]))])
    if has_known:
        c = np.vstack([-(full[0, 1:] @ c)[None, :] / full[0, 0], c])
    return c, theta, resid


# --- local reconstruction weights

def neighbour_vectors(nb: Neighbours) -> DataFrame:
    """node, x, near: the vector of a node and the (rank, dst, vector) list of its k neighbours."""
    d = 8 * len(nb.nodes.select("embedding").first()[0])
    links = Links(nb.knn.select("src", "rank", "dst"), nb.n, d + 16)
    got = links.attach(links.edges, "dst", nb.nodes.select("node", "embedding"), {"embedding": "e"})
    lists = got.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "e"))).alias("near"))
    return lists.join(nb.nodes.select(F.col("node").alias("src"), F.col("embedding").alias("x")), "src").select(
        F.col("src").alias("node"), "x", F.col("near.dst").alias("dst"), F.flatten("near.e").alias("near"))


def barycentre_weights(nb: Neighbours, reg: float = 1e-3, solve=None) -> DataFrame:
    """src, dst, w: the weights that rebuild every row from its neighbours; they sum to one.

    ``solve(c, node ids)`` may replace the regularised solution of C w = 1.
    """
    rows = neighbour_vectors(nb)

    def plain(c, _):
        k = c.shape[1]
        trace = np.trace(c, axis1=1, axis2=2)
        ridge = np.where(trace > 0, reg * trace, reg)
        w = np.linalg.solve(c + ridge[:, None, None] * np.eye(k), np.ones((len(c), k, 1)))[:, :, 0]
        return w / w.sum(axis=1, keepdims=True)

    chosen = solve or plain

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = to_matrix(batch.column(1))
            counts = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            dst = batch.column(2).flatten().to_numpy()
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, x.shape[1])
            first = np.concatenate([[0], np.cumsum(counts)])
            ids = batch.column(0).to_numpy()
            weights = np.zeros(len(dst))
            for size in np.unique(counts):
                at = np.flatnonzero(counts == size)
                where = first[at][:, None] + np.arange(size)[None, :]
                z = flat[where] - x[at][:, None, :]
                weights[where] = chosen(np.einsum("nad,nbd->nab", z, z), ids[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, counts)), pa.array(dst), pa.array(weights)], names=["src", "dst", "w"])

    first = nb.nodes.select("embedding").first()
    k = nb.knn.agg(F.max("rank")).first()[0] or 1
    with arrow_rows(nb.nodes.sparkSession, 8 * len(first[0]) * (k + 1), WIDE_BATCH):
        return cut(rows.mapInArrow(run, "src bigint, dst bigint, w double"))
