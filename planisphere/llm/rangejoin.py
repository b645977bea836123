"""Exact near-duplicates of vectors by a metric range join.

Unit vectors with cosine of at least c lie within ``sqrt(2 - 2c)`` of one another.
Pivots cut the space into cells. A vector lives in the cell of its nearest pivot and
visits each lower cell that a vector within the radius may live in: by the triangle
inequality that needs its distance from the border between both pivots, and its
distance from the other cell's ball, to be at most the radius. Cells are then joined
each by itself, so every pair meets exactly once.

A cell of many rows is split into chunks that meet pair by pair. A task holds one
chunk and streams the others past it; it returns one row per linked vector (its
number of links and the smallest vector it is connected to here), never pairs. Copies
of a vector are one row with a count, so a group of copies of any size costs nothing.

Defined cases: null ids, null, empty and zero vectors, vectors with null or non-finite
entries or of unusual length link with nothing (rows with a null id keep a null
component); a vector linked with nothing is its own component; repeated ids count as rows
of their own for the number of links; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.llm.common import map_batches, parts
from planisphere.llm.components import components, local_roots
from planisphere.llm.vectors import by_key, matrix, sample, unit, valid_vectors
from planisphere.session import cut

CELL_ROWS = 4096
MAX_PIVOTS = 4096
SAMPLE_PER_PIVOT = 16
SLACK = 1e-9


def pivots(points: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """``count`` pivots: sample rows moved to the middle of their cells a few times."""
    if count >= len(points):
        return points if len(points) else points
    centre = points[:count].copy()
    for _ in range(rounds):
        near = np.argmax(points @ centre.T - 0.5 * np.einsum("ij,ij->i", centre, centre), axis=1)
        for j in range(count):
            mine = points[near == j]
            if len(mine):
                centre[j] = mine.mean(axis=0)
    return centre


def range_links(classes: DataFrame, cosine: float = 0.95, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """From ``vec_id, embedding, copies`` (distinct vectors): ``vec_id, links, root`` per vector and task in which it has links."""
    spark = classes.sparkSession
    rows = classes.count()
    want = max(1, min(max_pivots, math.ceil(rows / cell_rows)))
    pivot = pivots(sample(classes, want * SAMPLE_PER_PIVOT if want > 1 else 1), want)
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    vector = dict(classes.dtypes)["embedding"]
    shared = spark.sparkContext.broadcast(pivot)  # at most max_pivots rows

    def distances(x):
        p = shared.value
        return np.sqrt(np.maximum(1 - 2 * (x @ p.T) + np.einsum("ij,ij->i", p, p), 0))

    def live(batch):
        d = distances(unit(matrix(batch.column(1))))
        home = np.argmin(d, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], ["cell", "d"])

    cells = map_batches(classes.select("vec_id", "embedding"), live, "cell int, d double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("reach")).collect()
    chunks, reach = np.ones(max(len(pivot), 1), np.int64), np.full(max(len(pivot), 1), -1.0)
    for c in cells:  # one row per pivot
        chunks[c.cell], reach[c.cell] = math.ceil(c.n / cell_rows), c.reach
    gap = np.sqrt(np.maximum(((pivot[:, None] - pivot[None]) ** 2).sum(-1), 1e-300)) if len(pivot) <= 512 else None

    def deal(batch):
        p = shared.value
        square = np.einsum("ij,ij->i", p, p)
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            d = distances(unit(matrix(part.column(1))))
            n = len(d)
            home = np.argmin(d, axis=1)
            # Of many pivots the gaps are not kept; from products they are a little inexact, so the border is drawn a little wider.
            between = gap[home] if gap is not None else np.sqrt(np.maximum(square[home][:, None] + square[None] - 2 * (p[home] @ p.T), 0)) + 1e-6
            border = (d**2 - d[np.arange(n), home][:, None] ** 2) / (2 * between)
            visit = (border <= radius) & (d <= reach[None] + radius) & (np.arange(len(p))[None] < home[:, None])
            own = np.asarray(part.column(0)) * 0 + (np.asarray(part.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks[home]
            who, where, chunk, role = [], [], [], []
            who.append(np.arange(n)), where.append(home), chunk.append(own), role.append(np.zeros(n, np.int64))
            times = own  # within its own cell a row meets each lower chunk
            who.append(np.repeat(np.arange(n), times)), where.append(np.repeat(home, times)), chunk.append(_upto(times)), role.append(np.ones(times.sum(), np.int64))
            i, j = np.nonzero(visit)
            times = chunks[j]
            who.append(np.repeat(i, times)), where.append(np.repeat(j, times)), chunk.append(_upto(times)), role.append(np.ones(times.sum(), np.int64))
            who, where, chunk, role = (np.concatenate(x) for x in (who, where, chunk, role))
            for s in range(0, len(who), 8192):
                take = pa.array(who[s : s + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[s : s + 8192].astype(np.int32)) for x in (where, chunk, role)] + [part.column(k).take(take) for k in range(3)],
                    ["cell", "chunk", "role", "vec_id", "embedding", "copies"],
                )

    def join(batches):
        def result(ids, links, a, b):
            found = np.flatnonzero(links)
            if not len(found):
                return
            nodes, roots = local_roots(np.concatenate([ids[found], *a]), np.concatenate([ids[found], *b]))
            root = roots[np.searchsorted(nodes, ids[found])]
            for s in range(0, len(found), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 65536]) for x in (ids[found], links[found], root)], ["vec_id", "links", "root"])

        key, base, base_id, base_n, closed = None, [], [], [], False
        links, a, b = None, [], []
        for at, batch in by_key(batches, 2):
            if at != key:
                if key is not None:
                    if not closed:
                        yield from self_links(base, base_id, base_n, result)
                    else:
                        yield from result(base_id, links, a, b)
                key, base, base_id, base_n, closed, a, b = at, [], [], [], False, [], []
            role, ids, n = np.asarray(batch.column(2)), np.asarray(batch.column(3)), np.asarray(batch.column(5))
            x = unit(matrix(batch.column(4)))
            k = int(np.searchsorted(role, 1))
            if k:
                base.append(x[:k]), base_id.append(ids[:k]), base_n.append(n[:k])
            if k < len(role):
                if not closed:
                    base, base_id, base_n, closed = _joined(base, x), _joined(base_id, ids), _joined(base_n, n), True
                    links, a, b = within(base, base_id, base_n)
                for s in range(k, len(role), 1024):
                    near = x[s : s + 1024] @ base.T >= cosine
                    if not near.any():
                        continue
                    links += near.T @ n[s : s + 1024]
                    i, j = np.nonzero(near)
                    mine, theirs = ids[s : s + 1024], near @ base_n
                    nodes, roots = local_roots(np.concatenate([mine[i], *a]), np.concatenate([base_id[j], *b]))
                    a, b = [nodes], [roots]
                    yield from result(mine, theirs, a, b)
        if key is not None:
            if not closed:
                yield from self_links(base, base_id, base_n, result)
            else:
                yield from result(base_id, links, a, b)

    def within(base, ids, n):
        links, a, b = np.zeros(len(base), np.int64), [], []
        for s in range(0, len(base), 1024):
            near = base[s : s + 1024] @ base.T >= cosine
            i, j = np.nonzero(near)
            other = i + s != j
            i, j = i[other], j[other]
            if len(i):
                np.add.at(links, i + s, n[j])
                nodes, roots = local_roots(np.concatenate([ids[i + s], *a]), np.concatenate([ids[j], *b]))
                a, b = [nodes], [roots]
        return links, a, b

    def self_links(base, ids, n, result):
        if base:
            base, ids, n = np.concatenate(base), np.concatenate(ids), np.concatenate(n)
            links, a, b = within(base, ids, n)
            yield from result(ids, links, a, b)

    dealt = map_batches(classes.select("vec_id", "embedding", "copies"), deal, f"cell int, chunk int, role int, vec_id bigint, embedding {vector}, copies bigint")
    dealt = dealt.repartition(parts(spark), "cell", "chunk").sortWithinPartitions("cell", "chunk", "role")
    return dealt.mapInArrow(join, "vec_id bigint, links bigint, root bigint")


def _upto(times: np.ndarray) -> np.ndarray:
    """0 .. t-1 for each t of ``times``, one after another."""
    total = int(times.sum())
    return np.arange(total) - np.repeat(np.cumsum(times) - times, times)


def _joined(found: list, like: np.ndarray) -> np.ndarray:
    return np.concatenate(found) if found else like[:0]


def near_vectors(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    v = valid_vectors(df, id_col, vector_col)
    copies = cut(v.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    found = cut(range_links(copies, cosine, cell_rows))
    linked = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = copies.join(sums, "vec_id", "left").join(linked.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    named = named.select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "vec_id").alias("_component"))
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"))
    # A null id is no member of a class, although its vector may equal one.
    joined = rows.join(named, (rows["embedding"] == named["embedding"]) & rows["vec_id"].isNotNull(), "left")
    component = F.coalesce("_component", "vec_id")
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
