"""Dense node numbers and seeded random pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planisphere.functions.seeded import hash_order, u01
from planisphere.functions.vectors import map_matrix
from planisphere.operators.subset import assign_ids
from planisphere.session import cut


def number_nodes(df: DataFrame, key: str = "item_id", out: str = "node") -> DataFrame:
    """Dense node numbers 0..n-1 in key order."""
    return assign_ids(df, [key], out)


ROUNDS = 12


def permuted(slot: Column, size: Column, keys: Column, seed, *key: Column) -> Column:
    """Where a keyed permutation of 0 .. size - 1 takes ``slot``: a swap-or-not shuffle.

    Every round pairs the places x and key - x, and one hash of the pair says whether they change
    places; so no place is taken twice, whatever the size. ``keys``: one number below size per round.
    """

    def round_(x, r):
        other = F.pmod(F.element_at(keys, r + 1) - x, size)
        return F.when(u01(seed, *key, r, F.greatest(x, other)) < 0.5, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), slot.cast("bigint"), round_)


def random_pairs(nodes: DataFrame, n: int, per_node: int, seed, avoid: DataFrame | None = None, short: str = "raise") -> DataFrame:
    """``per_node`` seeded partners of every node of 0 .. n - 1, none of them twice: src, slot, dst.

    The admissible partners of a node, all others but those of ``avoid``, are numbered; a keyed permutation
    of these numbers deals them to the slots in one pass. A node with fewer admissible partners than slots is
    an error, or with ``short="all"`` gets each of them once.
    """
    base = nodes.select(F.col("node").alias("src"))
    if avoid is None:
        listed = base.withColumn("_out", F.array("src"))
    else:
        mine = avoid.filter((F.col("dst") != F.col("src")) & F.col("dst").between(0, n - 1)).groupBy("src").agg(F.collect_set("dst").alias("_near"))
        listed = base.join(mine, "src", "left").select("src", F.sort_array(F.concat(F.coalesce("_near", F.array().cast("array<bigint>")), F.array("src"))).alias("_out"))
    size = (F.lit(n) - F.size("_out")).cast("bigint")
    if short == "raise":
        enough = F.when(size >= per_node, size).otherwise(F.raise_error(F.concat(F.lit("node "), F.col("src").cast("string"), F.lit(f" has fewer than {per_node} partners"))).cast("bigint"))
    else:
        enough = size
    keyed = listed.withColumn("_size", enough).withColumn("_keys", F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.floor(u01(seed, F.col("src"), F.lit("k"), r) * F.col("_size"))))
    last = F.least(F.lit(per_node), F.col("_size")) - 1
    slots = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last)).otherwise(F.array().cast("array<bigint>"))
    drawn = keyed.select("src", "_out", "_size", "_keys", F.explode(slots).alias("slot")).withColumn("slot", F.col("slot").cast("int"))
    place = permuted(F.col("slot"), F.col("_size"), F.col("_keys"), seed, F.col("src"))
    # The place counts admissible nodes only: every node left out before it shifts it by one.
    dst = F.aggregate("_out", F.col("_place"), lambda at, out: F.when(out <= at, at + 1).otherwise(at))
    return drawn.withColumn("_place", place).select("src", "slot", dst.alias("dst"))


def landmarks_maxmin(df: DataFrame, count: int, key: str = "item_id", vec: str = "embedding", seed: int = 42, batch: int = 4096) -> DataFrame:
    """Landmarks by farthest-point traversal: pick, rank, item id, vector.

    The distance of every row to its nearest landmark is kept as a column. A pass brings the ``batch`` farthest
    rows; picks among them are exact while the farthest of them is farther than any row left out could be, and only
    the new picks are measured in the next pass.
    """
    first = df.orderBy(hash_order(seed, F.col(key)), F.col(key)).limit(1).select(key, vec).collect()
    chosen = [(0, r[key], list(map(float, r[vec]))) for r in first]
    kind = df.schema[key].dataType.simpleString()
    state, fresh = df.select(key, F.col(vec).alias("_keep"), F.lit(float("inf")).alias("_gap")), chosen[:]
    while fresh and len(chosen) < count:
        marks = np.array([c[2] for c in fresh])

        def gap(x, marks=marks):
            best = np.full(len(x), np.inf)
            for m in marks:
                best = np.minimum(best, ((x - m) ** 2).sum(axis=1))
            return np.sqrt(best)[:, None]

        measured = map_matrix(state.withColumn("_vec", F.col("_keep")), "_vec", gap, out="_new")
        state = cut(measured.select(key, "_keep", F.least("_gap", F.col("_new")[0]).alias("_gap")), replaces=state)
        order = F.round("_gap", 12)
        far = state.orderBy(order.desc(), F.col(key)).limit(batch).collect()
        x, g = np.array([r["_keep"] for r in far]), np.array([r["_gap"] for r in far])
        bound = round(float(g[-1]), 12) if len(far) == batch else -1.0
        fresh = []
        while len(far) and len(chosen) + len(fresh) < count:
            near = np.round(g, 12)
            i = int(np.argmax(near))  # of equal ones the first, which has the smallest key
            if g[i] <= 0 or (fresh and near[i] <= bound):
                break
            fresh.append((len(chosen) + len(fresh), far[i][key], list(map(float, x[i]))))
            g = np.minimum(g, np.sqrt(((x - x[i]) ** 2).sum(axis=1)))
        chosen += fresh
    return df.sparkSession.createDataFrame(chosen, f"pick int, {key} {kind}, {vec} array<double>")


def nth_neighbour(knn: DataFrame, first: int, last: int) -> DataFrame:
    """Mean distance to the ``first``-th to ``last``-th neighbour per source."""
    return knn.filter(F.col("rank").between(first, last)).groupBy("src").agg(F.avg("dist").alias("scale"))


def rank_by(df: DataFrame, group: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
