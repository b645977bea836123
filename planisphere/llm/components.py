"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.session import cut


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node that each reaches; numpy, for the links one task holds."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while True:  # halve the paths
            short = root[root]
            if (short == root).all():
                break
            root = short


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node.

    A round is two aggregates (the smallest neighbour of each node, formed before
    the shuffle) and two joins back on the node, which adaptive execution splits for
    a node with very many links. The links left are written after each round, so a
    lost executor costs one round. The number of rounds grows with the logarithm of
    the longest path. Loops and repeated links do not matter; no links give no rows.
    """

    def state(df):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    kind = dict(links.dtypes)[a]
    now = cut(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = state(now)
    while seen.n:
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = cut(small.distinct(), replaces=now)
        now, before = new, seen
        seen = state(now)
        if seen == before:
            break
    stars = now.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
