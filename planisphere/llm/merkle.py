"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf, the digest of its fields. The leaves of a source ascend by id;
every ``FAN`` consecutive nodes become one node of the next level until a single one,
the source's subroot, remains; the subroots, ordered by source, make a tree of the
same kind up to the root.

Leaves are numbered within their source by a distributed sort and dealt in
superblocks: ``SPAN`` consecutive leaves of a large source, or several small sources that
begin in the same stretch of ``SPAN`` rows. A superblock is reduced to its top nodes by itself;
only those go on, in superblocks of their own, until the root. On the way down
the digests above a superblock (the runs its top node meets up to the root) and the
superblock's nodes are cogrouped: one pass over them in ``applyInPandas`` finishes the local
levels, joins the proof of every leaf and folds the leaf that was found later.

A group holds ``2 * SPAN`` nodes at most, whatever the size of a source; the digests that
travel per superblock grow with the logarithm of the table.

Defined cases: a null field counts as ``-``; null ids come first in their source and equal
ids are ordered by their leaves, so repeated rows are neighbours and interchangeable; the
null source comes first; an empty table gives an empty result; other columns do not
matter. A source with one leaf is its own subroot, a table with one source has its
subroot as root; a leaf without siblings has the digest of nothing as its proof.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planisphere.functions.skew import salted_join
from planisphere.operators.subset import assign_ids
from planisphere.session import BROADCAST_BYTES, cut

FAN, LEVELS = 16, 3
SPAN = FAN**LEVELS
DIGEST = 64  # hexadecimal digits
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<at:int,run:string>>"


def leaf(*fields: Column) -> Column:
    """Digest of the fields: ``-`` for null, else the bytes of its text, a colon and the text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(hashes: list[str], most: int | None) -> list[list[str]]:
    """The nodes level by level: ``most`` steps up, or to a single node where that is none."""
    levels = [hashes]
    while len(levels) <= most if most is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


# ---- numbering


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of (id, grp, leaf, ...) with ``tree`` (number of the source), ``rank`` in it, its size ``n`` and first row ``first``.

    Sources are told apart by text that is never null; their table is broadcast where its size allows, else the
    join splits the rows of large sources.
    """
    placed = assign_ids(rows, ["grp", "id", "leaf", "_at"], "_no").withColumn("_key", F.coalesce(F.concat(F.lit("="), "grp"), F.lit("")))
    sources = cut(placed.groupBy("_key").agg(F.min("_no").alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.length("_key")).alias("_wide")))
    trees = assign_ids(sources, ["first"], "tree")
    size = trees.agg(F.sum(F.col("_wide") * 4 + 32).alias("bytes"), F.sum("n").alias("rows")).first()
    trees = trees.drop("_wide")
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        joined = placed.join(F.broadcast(trees), "_key")
    else:
        joined = salted_join(placed, trees, "_key", size["rows"], "_no")
    return joined.withColumn("rank", F.col("_no") - F.col("first")).drop("_no", "_key", "_at", "grp")


def dealt(nodes: DataFrame, tier: int) -> DataFrame:
    """``block``: the superblock of a node, the same for whole small trees that begin close together.

    ``n``, ``rank``: nodes of the tree at this tier; ``first``: where its leaves begin.
    """
    small = F.struct(F.lit(-1).cast("bigint").alias("a"), F.shiftright("first", 4 * LEVELS * (tier + 1)).alias("b"))
    large = F.struct(F.col("tree").alias("a"), F.shiftright("rank", 4 * LEVELS).alias("b"))
    return nodes.withColumn("block", F.when(F.col("n") <= SPAN, small).otherwise(large))


# ---- up: tops of superblocks


def tops_of(group: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, nodes in group.sort_values(["tree", "rank"]).groupby("tree", sort=False):
        head = nodes.iloc[0]
        top = levels_of(nodes["h"].tolist(), LEVELS if head["n"] > SPAN else None)[-1][0]
        out.append((head["tree"], head["first"], head["rank"] // SPAN, -(-head["n"] // SPAN), top, head["block"]["a"], head["block"]["b"], head["n"] <= SPAN))
    return pd.DataFrame(out, columns=["tree", "first", "rank", "n", "h", "a", "b", "done"])


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of nodes with their superblocks, from the given ones up; and each tree's last node with the tier that made it."""
    tiers, last = [], None
    while True:
        tiers.append(cut(dealt(nodes, len(tiers))))
        tops = cut(tiers[-1].select("tree", "first", "rank", "n", "h", "block").groupBy("block").applyInPandas(
            tops_of, "tree bigint, first bigint, rank bigint, n bigint, h string, a bigint, b bigint, done boolean"))
        ends = tops.filter("done").select("tree", "h", F.lit(len(tiers) - 1).alias("tier"), F.struct("a", "b").alias("block"))
        last = ends if last is None else last.unionByName(ends)
        nodes = tops.filter("not done").select("tree", "first", "rank", "n", "h", F.struct("a", "b").alias("below"))
        if nodes.isEmpty():
            return tiers, last


# ---- down: what is above a superblock meets its nodes


def local_paths(nodes: pd.DataFrame, outer: pd.DataFrame):
    """Per tree of a superblock: its nodes in order, the runs of its levels, and the path above."""
    above = outer.set_index("tree")
    for tree, part in nodes.sort_values(["tree", "rank"]).groupby("tree", sort=False):
        hashes = part["h"].tolist()
        levels = levels_of(hashes, LEVELS if part["n"].iloc[0] > SPAN else None)
        runs = [["".join(level[i : i + FAN]) for i in range(0, len(level), FAN)] for level in levels[:-1]]
        yield part, levels, runs, above.loc[tree]


def paths_down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The path of every node: its place and run at each level up to the root."""
    out = []
    for part, _, runs, above in local_paths(nodes, outer):
        for i, (tree, first, below) in enumerate(zip(part["tree"], part["first"], part["below"])):
            path, at = [], i
            for level in runs:
                path.append({"at": at % FAN, "run": level[at // FAN]})
                at //= FAN
            out.append((tree, below["a"], below["b"], above["subroot"], path + list(above["path"])))
    return pd.DataFrame(out, columns=["tree", "a", "b", "subroot", "path"])


def siblings(run: str, at: int) -> str:
    return run[: DIGEST * at] + run[DIGEST * (at + 1) :]


def folded(node: str, path, cache: dict, upto: tuple) -> str:
    """The root that ``node`` leads to with the runs of ``path``; equal nodes at one place are folded once."""
    at = upto
    for k, (place, run) in enumerate(path):
        key = (k, at, node)
        if key not in cache:
            cache[key] = digest(run[: DIGEST * place] + node + run[DIGEST * (place + 1) :])
        node, at = cache[key], at // FAN
    return node


def audited(root: str):
    """Proofs and folded roots of the leaves of a superblock."""

    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, _, runs, above in local_paths(leaves, outer):
            outside = [(p["at"], p["run"]) for p in above["path"]]
            rest = "".join(siblings(r, at) for at, r in outside).encode()
            cache: dict = {}
            proofs, roots = [], []
            for i, found in enumerate(part["found"]):
                at, path = i, []
                for level in runs:
                    path.append((at % FAN, level[at // FAN]))
                    at //= FAN
                proof = hashlib.sha256("".join(siblings(r, p) for p, r in path).encode())
                proof.update(rest)
                proofs.append(proof.hexdigest())
                roots.append(folded(found, path + outside, cache, i))
            out.append(pd.DataFrame({"id": part["id"], "leaf": part["h"], "subroot": above["subroot"], "root": root, "proof_sha256": proofs, "folded_root": roots, "verified": np.array(roots) == root}))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def joined_paths(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    return cut(nodes.groupBy("block").cogroup(outer.groupBy("block")).applyInPandas(
        paths_down, f"tree bigint, a bigint, b bigint, subroot string, path {PATH}").select("tree", F.struct("a", "b").alias("block"), "subroot", "path"))


def descend(tiers: list[DataFrame], ends: DataFrame) -> DataFrame:
    """Paths above the superblocks of the lowest tier. ``ends``: per tree its last ``tier``, ``block``, ``subroot`` and ``path`` above."""
    outer = None
    for tier in range(len(tiers) - 1, -1, -1):
        here = ends.filter(F.col("tier") == tier).select("tree", "block", "subroot", "path")
        outer = here if outer is None else outer.unionByName(here)
        if tier:
            outer = joined_paths(tiers[tier], outer)
    return outer


def manifest(docs: DataFrame, found: dict[str, Column] | None = None, fields=FIELDS, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """One row per document: its id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``found`` replaces columns by what an audit finds in their place; the leaf of what was found is folded with the
    siblings of the original, and verified where that leads to the root.
    """
    found = found or {}
    columns = {c: F.col(c) for c in fields}
    same = [v.eqNullSafe(columns[c]) for c, v in found.items()]
    original = leaf(*columns.values())
    again = leaf(*(columns | found).values())
    for unchanged in same:
        again = F.when(unchanged, original).otherwise(again) if len(same) == 1 else again
    kind = dict(docs.dtypes)[id_col]
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), original.alias("leaf"), again.alias("found"), F.monotonically_increasing_id().alias("_at")))

    leaves = numbered(rows).withColumnRenamed("leaf", "h")
    tiers, subroots = climb(leaves)
    # The trees are numbered by source, so their numbers are the ranks of the subroots in the tree of the root.
    count = subroots.count()
    out = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if count == 0:
        return docs.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    forest = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(0).cast("bigint").alias("first"), F.col("tree").alias("rank"), F.lit(count).cast("bigint").alias("n"), "h",
                             F.struct(F.col("tree").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("below"))
    upper, top = climb(forest)
    head = top.first()
    root = head["h"]
    ends = top.select("tree", "tier", "block", F.lit("").alias("subroot"), F.expr(f"cast(array() as {PATH})").alias("path"))
    above = joined_paths(upper[0], descend(upper, ends)).select(F.col("block.a").alias("tree"), "path")
    outer = descend(tiers, subroots.withColumnRenamed("h", "subroot").join(above, "tree"))
    return tiers[0].groupBy("block").cogroup(outer.groupBy("block")).applyInPandas(audited(root), out).withColumnRenamed("id", id_col)
