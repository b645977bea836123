"""Counts, duplicate reports and data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planisphere.functions.vectors import distance
from planisphere.operators.pairs import random_pairs
from planisphere.operators.subset import assign_ids
from planisphere.session import cut


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def dup_report(points: DataFrame, method: str, config_id: int) -> DataFrame:
    """All versus distinct item ids of one run."""
    run = points.filter((F.col("method") == method) & (F.col("config_id") == config_id))
    # The distinct ids are reduced to one row each before they are counted.
    per_item = run.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    return per_item.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("item_id").alias("unique_items"))


def dup_report_all(points: DataFrame) -> DataFrame:
    """The same for every run; pre-grouping by item keeps a big run off one task."""
    per_item = points.groupBy("method", "config_id", "item_id").agg(F.count(F.lit(1)).alias("c"))
    return per_item.groupBy("method", "config_id").agg(
        F.sum("c").alias("total"), F.count("item_id").alias("unique_items")
    )


def vector_stats(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Shape, element type, smallest and largest cell, and whether any cell is NaN or infinite."""
    v = F.col(vec)
    inf = float("inf")
    kind = df.schema[vec].dataType.elementType.simpleString()
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size(v)).alias("min_dim"),
        F.max(F.size(v)).alias("max_dim"),
        F.lit(kind).alias("dtype"),
        F.min(F.array_min(v)).cast("double").alias("min_value"),
        F.max(F.array_max(v)).cast("double").alias("max_value"),
        F.coalesce(F.max(F.exists(v, lambda x: F.isnan(x))), F.lit(False)).alias("has_nan"),
        F.coalesce(F.max(F.exists(v, lambda x: F.abs(x) == inf)), F.lit(False)).alias("has_inf"),
    )


def matrix_min(df: DataFrame, vec: str = "embedding") -> DataFrame:
    return df.agg(F.min(F.array_min(vec)).cast("double").alias("min_value"))


def collect_ids(viz_points: DataFrame) -> DataFrame:
    """Ordered point ids of every visualisation in chunks of bounded length.

    A list of all ids of one visualisation would have to fit into one cell of one
    task; chunks by id range keep the same order and any size.
    """
    chunk = F.floor(F.col("point_id") / F.lit(65536)).cast("bigint")
    return (
        viz_points.groupBy("viz_id", chunk.alias("chunk"))
        .agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"))
    )


def run_coverage(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Points and groups of every run against the requested size."""
    per_group = points.groupBy("method", "config_id", "group_key").agg(F.count(F.lit(1)).alias("c"))
    got = per_group.groupBy("method", "config_id").agg(
        F.sum("c").alias("points"), F.count(F.lit(1)).alias("groups"), F.max("c").alias("largest_group")
    )
    return (
        runs.select("method", "config_id", "subset_size").join(got, ["method", "config_id"], "left")
        .select(
            "method", "config_id", "subset_size",
            F.coalesce("points", F.lit(0)).alias("points"),
            F.coalesce("groups", F.lit(0)).alias("groups"),
            F.coalesce("largest_group", F.lit(0)).alias("largest_group"),
            (F.coalesce("points", F.lit(0)) >= F.col("subset_size")).alias("complete"),
        )
    )


def require_2d(df: DataFrame, coords: str = "coords") -> DataFrame:
    """Rows whose coordinate count is not two; an empty result means the table may be drawn."""
    return df.filter(F.col(coords).isNull() | (F.size(coords) != 2))


def missing_names(points: DataFrame, name: str = "item_id") -> DataFrame:
    """Points that carry an item id."""
    return points.filter(has_name(F.col(name)))


def has_name(name: Column) -> Column:
    return name.isNotNull() & (name.cast("string") != "")


def missing_assets(points: DataFrame, assets: DataFrame, key: str = "item_id") -> DataFrame:
    """Points whose picture is absent from the asset manifest."""
    return points.join(assets.select(key), key, "left_anti")


def orphan_viz_points(viz_points: DataFrame, points: DataFrame, viz: DataFrame) -> DataFrame:
    """Canvas points whose projection point or visualisation no longer exists."""
    no_point = viz_points.join(points.select("point_id"), "point_id", "left_anti").select(
        "viz_id", "point_id", F.lit("point").alias("missing")
    )
    no_viz = viz_points.join(viz.select("viz_id"), "viz_id", "left_anti").select(
        "viz_id", "point_id", F.lit("viz").alias("missing")
    )
    return no_point.unionByName(no_viz)


def distance_agreement(coords: DataFrame, vectors: DataFrame, per_row: int = 8, vec: str = "embedding", near: DataFrame | None = None) -> DataFrame:
    """One row: how a map keeps the distances of the vectors it shows.

    ``agreement`` is the correlation of both distances over ``per_row`` seeded partners of every row: 0 for a map that
    has nothing to do with the vectors, 1 for one that keeps all distances. ``closeness``, with a table ``near`` of
    neighbours (src, dst by item), is the mean distance of neighbours on the map over that of the partners: 1 for
    a map without relation.
    """
    numbered = cut(assign_ids(coords.select("item_id", "x", "y").join(vectors.select("item_id", F.col(vec).alias("_v")), "item_id"), ["item_id"], "node"))
    n = numbered.count()
    pairs = random_pairs(numbered, n, min(per_row, max(n - 1, 1)), 17, short="all")
    sides = [numbered.select(F.col("node").alias(e), F.struct("x", "y", "_v").alias(f"_{e}")) for e in ("src", "dst")]
    met = pairs.join(sides[1], "dst").join(sides[0], "src")
    flat = F.hypot(F.col("_src.x") - F.col("_dst.x"), F.col("_src.y") - F.col("_dst.y"))
    full = distance(F.col("_src._v"), F.col("_dst._v"))
    moments = [F.avg(a) for a in ("f", "g")] + [F.var_pop("f"), F.var_pop("g"), F.covar_pop("f", "g")]
    row = met.select(flat.alias("f"), full.alias("g")).agg(*[m.alias(c) for m, c in zip(moments, ("mf", "mg", "vf", "vg", "c"))])
    out = row.select((F.col("c") / F.sqrt(F.greatest(F.col("vf") * F.col("vg"), F.lit(1e-300)))).alias("agreement"), "mf")
    if near is None:
        return out.drop("mf")
    at = numbered.select("item_id", "x", "y")
    ends = [at.select(F.col("item_id").alias(e), F.struct("x", "y").alias(f"_{e}")) for e in ("src", "dst")]
    close = near.select("src", "dst").join(ends[1], "dst").join(ends[0], "src").agg(F.avg(flat).alias("m")).scalar()
    return out.select("agreement", (close / F.greatest("mf", F.lit(1e-300))).alias("closeness"))
