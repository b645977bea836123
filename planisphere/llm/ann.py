"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced partitions; a small
classifier learns from a vector which partition it belongs to. Every row of the table
is stored in the partition it is classified into. A query goes to its most probable
partitions, as many as a held-out part of the sample needs for the wanted
recall, and the rows there are ranked again by the exact cosine.

Large partitions are split into chunks of bounded rows that each query visits, so a
partition (or one vector repeated in a third of all rows) never has to fit into one task. A
task returns the best ``k`` of a chunk per query; ties go to the smaller id.

Defined cases: vectors that are null, empty, zero, of unusual length or hold null or
non-finite entries, and rows with a null id, take no part; a query is not its own
candidate, nor is a row with the same id; fewer candidates than ``k`` give all of
them; no queries or no rows give no rows; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planisphere.llm.common import map_batches, parts
from planisphere.llm.vectors import by_key, matrix, near_one, sample, unit, valid_vectors
from planisphere.session import cut

SAMPLE_ROWS = 8192
PARTITIONS = 16
CHUNK_ROWS = 8192


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each row."""
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        near = x[s : s + 1024] @ x.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -np.inf
        out[s : s + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(graph: np.ndarray, x: np.ndarray, count: int, slack: float = 0.05, rounds: int = 30, seed: int = 42) -> np.ndarray:
    """Labels 0..count-1 of about equal size that cut few edges.

    Starts from seeded halves along principal directions and moves nodes to the part
    that holds most of their neighbours, best gains first, while the part has room.
    """
    n = len(x)
    label = np.zeros(n, np.int64)
    groups = [(np.arange(n), 0, count)]
    while groups:
        rows, first, many = groups.pop()
        if many == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        _, _, axis = np.linalg.svd(centred[:2048], full_matrices=False)
        order = rows[np.argsort(centred @ axis[0], kind="stable")]
        left = many // 2
        split = len(rows) * left // many
        groups += [(order[:split], first, left), (order[split:], first + left, many - left)]
    room = math.ceil(n / count * (1 + slack))
    both = np.concatenate([graph, np.zeros_like(graph)], axis=1)[:, : graph.shape[1]]
    source, target = np.repeat(np.arange(n), both.shape[1]), both.ravel()
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        votes = np.bincount(source * count + label[target], minlength=n * count).reshape(n, count)
        best = np.argmax(votes, axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        size = np.bincount(label, minlength=count)
        wish = np.flatnonzero((gain > 0) & (rng.random(n) < 0.5))
        moved = 0
        for i in wish[np.argsort(-gain[wish], kind="stable")].tolist():
            if size[best[i]] < room:
                size[best[i]] += 1
                size[label[i]] -= 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """Multinomial classifier with one hidden layer, trained by Adam."""

    def __init__(self, x: np.ndarray, label: np.ndarray, count: int, hidden: int = 128, epochs: int = 40, seed: int = 42):
        rng, d = np.random.default_rng(seed), x.shape[1]
        self.w = [rng.normal(0, math.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, count)), np.zeros(count)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), 256):
                rows = order[s : s + 256]
                h = np.maximum(x[rows] @ self.w[0] + self.w[1], 0)
                p = softmax(h @ self.w[2] + self.w[3])
                p[np.arange(len(rows)), label[rows]] -= 1
                p /= len(rows)
                back = (p @ self.w[2].T) * (h > 0)
                grads = [x[rows].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ p + 1e-4 * self.w[2], p.sum(0)]
                t += 1
                rate = 0.003 * 0.5 ** (epoch / 15)
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def probable(self, x: np.ndarray) -> np.ndarray:
        return softmax(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Partitions:
    """A fitted router and the number of partitions that a query visits."""

    def __init__(self, x: np.ndarray, count: int = PARTITIONS, k: int = 5, recall: float = 0.97, seed: int = 42):
        self.count = max(1, min(count, len(x) // 32))
        self.probes, self.router = 1, None
        if self.count == 1:
            return
        held = x[:: 8]
        fit = x[np.arange(len(x)) % 8 != 0]
        label = balanced_partition(neighbour_graph(fit, min(10, len(fit) - 1)), fit, self.count, seed=seed)
        self.router = Router(fit, label, self.count, seed=seed)
        # held-out rows ask for their neighbours in the whole sample
        near = np.array([self.stored(x[np.argsort(-s, kind="stable")[1 : k + 1]]) for s in held @ x.T])
        order = np.argsort(-self.router.probable(held), axis=1, kind="stable")
        for self.probes in range(1, self.count + 1):
            visited = (near[:, :, None] == order[:, None, : self.probes]).any(axis=2)
            if visited.mean() >= recall:
                break

    def stored(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(self.router.probable(x), axis=1) if self.router else np.zeros(len(x), np.int64)

    def visited(self, x: np.ndarray) -> np.ndarray:
        if not self.router:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.router.probable(x), axis=1, kind="stable")[:, : self.probes]


def best(query: np.ndarray, query_id: np.ndarray, base: np.ndarray, base_id: np.ndarray, k: int):
    """(query id, id, cosine) of the ``k`` best per query; the cosine of a pair does not depend on its place in a block."""
    out = []
    query, base = near_one(query), near_one(base)
    qn, bn = np.sqrt(np.einsum("ij,ij->i", query, query)), np.sqrt(np.einsum("ij,ij->i", base, base))
    scaled = (base / bn[:, None]).T
    step = 64
    for s in range(0, len(query), step):
        q, ids = query[s : s + step], query_id[s : s + step]
        rough = (q / qn[s : s + step, None]) @ scaled
        rough[ids[:, None] == base_id[None, :]] = -np.inf
        if len(base) > k:
            least = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero((rough >= least[:, None] - 1e-12) & (rough > -np.inf))
        else:
            i, j = np.nonzero(rough > -np.inf)
        score = np.empty(len(i))
        for at in range(0, len(i), 16384):
            a, b = i[at : at + 16384], j[at : at + 16384]
            score[at : at + 16384] = np.einsum("ij,ij->i", q[a], base[b]) / (qn[s + a] * bn[b])
        order = np.lexsort((base_id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out.append((ids[i[keep]], base_id[j[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(df: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, partitions: int = PARTITIONS, chunk_rows: int = CHUNK_ROWS, recall: float = 0.97, seed: int = 42) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``queries`` is a condition on ``vec_id`` that picks the query rows."""
    spark = df.sparkSession
    v = valid_vectors(df, id_col, vector_col)
    model = spark.sparkContext.broadcast(Partitions(sample(v, sample_rows, seed), partitions, k, recall, seed))  # bounded by the sample
    kind = dict(v.dtypes)["embedding"]

    def store(batch):
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            cell = model.value.stored(unit(matrix(part.column(1))))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column(0), part.column(1)], ["cell", "vec_id", "embedding"])

    index = cut(map_batches(v, store, f"cell int, vec_id bigint, embedding {kind}"))
    sizes = {r.cell: math.ceil(r["count"] / chunk_rows) for r in index.groupBy("cell").count().collect()}  # one row per partition
    chunks = np.array([sizes.get(i, 0) for i in range(model.value.count)], np.int64)

    def route(batch):
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            cells = model.value.visited(unit(matrix(part.column(1))))
            who, cell = np.repeat(np.arange(len(cells)), cells.shape[1]), cells.ravel()
            times = chunks[cell]
            who, cell = np.repeat(who, times), np.repeat(cell, times)
            chunk = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            for s in range(0, len(who), 8192):
                take = pa.array(who[s : s + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[s : s + 8192].astype(np.int32)), pa.array(chunk[s : s + 8192].astype(np.int32)), part.column(0).take(take), part.column(1).take(take)],
                    ["cell", "chunk", "vec_id", "embedding"],
                )

    asked = map_batches(index.filter(queries).select("vec_id", "embedding"), route, f"cell int, chunk int, vec_id bigint, embedding {kind}")
    counts = F.create_map(*[F.lit(int(x)) for c, n in enumerate(chunks) for x in (c, max(int(n), 1))])
    own = F.pmod(F.xxhash64("vec_id"), counts[F.col("cell")].cast("bigint")).cast("int")
    stored = index.select("cell", own.alias("chunk"), F.lit(0).alias("role"), "vec_id", "embedding")
    dealt = stored.union(asked.select("cell", "chunk", F.lit(1).alias("role"), "vec_id", "embedding"))
    dealt = dealt.repartition(parts(spark), "cell", "chunk").sortWithinPartitions("cell", "chunk", "role")

    def search(batches):
        key, base, ids = None, [], []
        for at, batch in by_key(batches, 2):
            if at != key:
                key, base, ids = at, [], []
            role, x, mine = np.asarray(batch.column(2)), matrix(batch.column(4)), np.asarray(batch.column(3))
            n = int(np.searchsorted(role, 1))
            if n:
                base.append(x[:n]), ids.append(mine[:n])
            if n < len(role) and base:
                base, ids = [np.concatenate(base)], [np.concatenate(ids)]
                for s in range(n, len(role), 512):
                    q, i, score = best(x[s : s + 512], mine[s : s + 512], base[0], ids[0], k)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(score)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id bigint, vec_id bigint, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
