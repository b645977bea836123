"""Repulsion of all points from a quadtree of cell sums.

The plane is halved level by level down to cells much smaller than the kernel. A cell is
known by its level and two integers, so parents and children meet on equal keys. Points
are dealt to blocks, the largest cells with few points. Every block opens cells from the
root down: a cell that is small against its distance stands for its points, any other is
replaced by its children in the next round, one join per level for all blocks at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.functions.skew import salted_join
from planisphere.session import BROADCAST_BYTES, cut

#: A cell never needs opening below this side: the kernel 1 / (1 + d^2) is flat there.
LEAF, MOST_LEVELS = 0.1, 24
BLOCK, CHUNK = 64, 4096
CELL = ["level", "cx", "cy"]


def cell_sums(state: DataFrame, low: tuple[float, float], side: float, levels: int) -> DataFrame:
    """level, cx, cy, n, x, y, v: occupied cells of all levels with their number of points, centre and mean variance of an axis."""
    scale = f"{float(2**levels / side)!r}D"
    placed = state.selectExpr(f"cast(floor((x - ({low[0]!r}D)) * {scale}) AS bigint) AS cx", f"cast(floor((y - ({low[1]!r}D)) * {scale}) AS bigint) AS cy", "x", "y")
    finest = placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.expr("sum(x * x + y * y) AS sr"))
    chain = f"inline(transform(sequence(0, {levels}), l -> struct(l AS level, shiftright(cx, {levels} - l) AS ax, shiftright(cy, {levels} - l) AS ay)))"
    every = finest.selectExpr("n", "sx", "sy", "sr", chain).groupBy("level", F.col("ax").alias("cx"), F.col("ay").alias("cy"))
    sums = every.agg(F.sum("n").alias("n"), (F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"), (F.sum("sr") / F.sum("n")).alias("r"))
    return sums.selectExpr(*CELL, "n", "x", "y", "greatest(r - x * x - y * y, 0D) / 2 AS v")


def blocks_of(cells: DataFrame, levels: int, block: int) -> DataFrame:
    """The largest cells with at most ``block`` points, and crowded ones of the finest level."""
    up = cells.select((F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("n").alias("above"))
    child = cells.select(*CELL, "n", F.shiftright("cx", 1).alias("px"), F.shiftright("cy", 1).alias("py"))
    small = (F.col("n") <= block) | (F.col("level") == levels)
    return child.filter(small).join(up, ["level", "px", "py"], "left").filter(F.col("above").isNull() | (F.col("above") > block)).select(*CELL, "n")


def opened(blocks: DataFrame, families: DataFrame, root: tuple, low: tuple[float, float], side: float, levels: int, theta: float, small: bool) -> DataFrame:
    """level, cx, cy of a block with the cells that stand for all points to it: n, x, y, v."""
    size = F.lit(float(side)) / F.pow(F.lit(2.0), F.col("level"))
    front = blocks.select(
        *CELL, (F.lit(low[0]) + F.col("cx") * size).alias("x0"), (F.lit(low[1]) + F.col("cy") * size).alias("y0"), size.alias("size"),
        F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("ax"), F.lit(0).cast("bigint").alias("ay"),
        F.lit(root[0]).cast("bigint").alias("n"), F.lit(root[1]).alias("x"), F.lit(root[2]).alias("y"), F.lit(root[3]).alias("v"))
    gap = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}0") - F.col("size"), F.lit(0.0))
    far = F.lit(theta * theta) * (gap("x") * gap("x") + gap("y") * gap("y"))
    for level in range(levels):
        wide = float(side) / 2**level
        wants = (F.col("at") == level) & (F.col("n") > 1) & (F.lit(wide * wide) >= far)
        # A cell that stays meets no family; its key is its own, so that these rows are not one hot key.
        own = -1 - F.pmod(F.xxhash64(*CELL, "ax", "ay"), F.lit(1 << 40))
        kin = families.filter(F.col("level") == level).select(F.col("cx").alias("kx"), F.col("cy").alias("ky"), "kids")
        met = front.withColumns({"kx": F.when(wants, F.col("ax")).otherwise(own), "ky": F.col("ay")}).join(F.broadcast(kin) if small else kin, ["kx", "ky"], "left")
        stay = F.array(F.struct("at", "ax", "ay", "n", "x", "y", "v"))
        front = met.select(*CELL, "x0", "y0", "size", F.explode(F.coalesce("kids", stay)).alias("c")).select(*CELL, "x0", "y0", "size", "c.*")
    return front.select(*CELL, "n", "x", "y", "v")


def _forces(points: pa.Table, cells: pa.Table) -> pa.Table:
    """Kernel sums of points over cells: the value at the centre and half the variance times the Laplacian of the kernel."""
    x, y = points.column("x").to_numpy(), points.column("y").to_numpy()
    n, cx, cy, v = (cells.column(c).to_numpy() for c in ("n", "x", "y", "v"))
    out = np.zeros((3, len(x)))
    for a in range(0, len(x), 256):
        dx, dy = x[a : a + 256, None] - cx[None], y[a : a + 256, None] - cy[None]
        r2 = dx * dx + dy * dy
        q = 1.0 / (1.0 + r2)
        q2 = q * q
        w = n * q2 * (1.0 + v * q * (12.0 * r2 * q - 8.0))
        out[:, a : a + 256] = (w * dx).sum(axis=1), (w * dy).sum(axis=1), (n * (q + v * q2 * (4.0 * r2 * q - 2.0))).sum(axis=1)
    return pa.table({"node": points.column("node"), "rx": out[0], "ry": out[1], "q": out[2]})


def tree_repulsion(state: DataFrame, theta: float = 0.5, leaf: float = LEAF, block: int = BLOCK, limit: int | None = None) -> DataFrame:
    """node, rx, ry, q: the sums of q^2 (y_i - y_j) and of q over all points j, the point itself counted in q.

    A cell is opened unless its side is below ``theta`` times its distance from the block. The tables of cells
    are broadcast where their size allows, else every round is a shuffle join. A crowded cell is split into
    chunks that each meet the block's list.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    b = state.selectExpr("min(x)", "max(x)", "min(y)", "max(y)").first()
    if b[0] is None:
        return state.selectExpr("node", "x AS rx", "y AS ry", "0D AS q")
    low, side = (float(b[0]), float(b[2])), max(b[1] - b[0], b[3] - b[2], 1e-12) * 1.0001
    levels = int(np.clip(np.ceil(np.log2(side / leaf)), 0, MOST_LEVELS))
    cells = cut(cell_sums(state, low, side, levels))
    small = cells.count() * 64 <= limit
    root = cells.filter("level = 0").select("n", "x", "y", "v").first()
    kids = F.collect_list(F.struct(F.col("level").alias("at"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), "n", "x", "y", "v"))
    families = cells.filter("level > 0").groupBy((F.col("level") - 1).alias("level"), F.shiftright("cx", 1).alias("cx"), F.shiftright("cy", 1).alias("cy")).agg(kids.alias("kids"))
    families = cut(families) if levels else families
    blocks = cut(blocks_of(cells, levels, block))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    lists = opened(blocks, families, tuple(root), low, side, levels, theta, small)
    crowded = blocks.select(*CELL, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    lists = lists.join(F.broadcast(crowded) if small else crowded, CELL)

    # Each finest cell lies in one block; points find it by their finest cell.
    scale = f"{float(2**levels / side)!r}D"
    points = state.selectExpr("node", "x", "y", f"cast(floor((x - ({low[0]!r}D)) * {scale}) AS bigint) * {1 << (MOST_LEVELS + 1)} + cast(floor((y - ({low[1]!r}D)) * {scale}) AS bigint) AS cell")
    chain = f"inline(transform(sequence(0, {levels}), l -> struct(l AS level, shiftright(fx, {levels} - l) AS cx, shiftright(fy, {levels} - l) AS cy)))"
    fine = cells.filter(F.col("level") == levels).selectExpr("cx AS fx", "cy AS fy").selectExpr(f"fx * {1 << (MOST_LEVELS + 1)} + fy AS cell", chain)
    home = fine.join(F.broadcast(blocks) if small else blocks, CELL).select("cell", *CELL, chunks.alias("chunks"))
    met = points.join(F.broadcast(home), "cell") if small else salted_join(points, cut(home), "cell", int(root["n"]), "node")
    dealt = met.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks").cast("bigint")).cast("int"))
    keys = [*CELL, "chunk"]
    return dealt.select(*keys, "node", "x", "y").groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInArrow(_forces, "node bigint, rx double, ry double, q double")
