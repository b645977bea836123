"""Registry of named queries and the SQL that states the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planisphere.operators.quality import distance_agreement
from planisphere.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor reaches."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, group_key, embedding (double) of the whole embeddings table."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("group_key"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def related(made: DataFrame, rows: DataFrame, least: float = 0.05, near: DataFrame | None = None, most: float = 0.97) -> Column:
    """Whether a map has to do with the vectors it shows; maps of shuffled rows fail, as tests show.

    Distances on the map agree with those of the vectors, or with ``near`` neighbours lie closer than other rows.
    """
    found = distance_agreement(made, rows, near=near).first()
    return F.lit(found["agreement"] >= least if near is None else found["closeness"] <= most)


# --- A run catalogue derived from the embeddings table: one run per label, one point per vector.

METHOD_SQL = "CASE label % 3 WHEN 0 THEN 'pca' WHEN 1 THEN 'umap' ELSE 'tsne' END"

CTE = f"""
runs AS (
  SELECT {METHOD_SQL} AS method, CAST(label + 1 AS BIGINT) AS config_id,
         CASE WHEN label % 2 = 0 THEN 'artist_first5' ELSE 'random' END AS subset_strategy,
         CAST(45 + label AS INTEGER) AS subset_size, CAST(count(*) AS DOUBLE) / 100 AS runtime, label,
         CASE WHEN label % 4 <> 0 THEN CAST(5 + label AS INTEGER) END AS n_neighbors,
         CAST(42 + label AS INTEGER) AS random_state
  FROM embeddings GROUP BY label),
points AS (
  SELECT vec_id + 1 AS point_id,
         CASE WHEN vec_id % 41 = 0 THEN NULL WHEN vec_id % 43 = 0 THEN ''
              WHEN vec_id % 10 = 9 THEN 'img_' || (vec_id - 1) ELSE 'img_' || vec_id END AS item_id,
         'NATION_' || label AS group_key, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
         {METHOD_SQL} AS method, CAST(label + 1 AS BIGINT) AS config_id
  FROM embeddings),
viz AS (
  SELECT config_id AS viz_id, method, config_id, method || '_' || config_id || '.avif' AS low_res,
         '2024-01-' || lpad(CAST(config_id AS VARCHAR), 2, '0') AS created_at FROM runs),
viz_points AS (
  SELECT config_id AS viz_id, point_id, CAST(round_even((x + 1) / 2 * 16383, 0) AS INTEGER) AS viz_x,
         CAST(round_even((y + 1) / 2 * 16383, 0) AS INTEGER) AS viz_y FROM points)
"""


def _method() -> Column:
    return F.when(F.col("label") % 3 == 0, "pca").when(F.col("label") % 3 == 1, "umap").otherwise("tsne")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    per_label = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return per_label.select(
        _method().alias("method"),
        (F.col("label") + 1).cast("bigint").alias("config_id"),
        F.when(F.col("label") % 2 == 0, "artist_first5").otherwise("random").alias("subset_strategy"),
        (F.lit(45) + F.col("label")).cast("int").alias("subset_size"),
        (F.col("n").cast("double") / 100).alias("runtime"),
        F.create_map(
            F.lit("n_components"), F.lit("2"),
            F.lit("n_neighbors"), F.when(F.col("label") % 4 != 0, (F.col("label") + 5).cast("string")),
            F.lit("metric"), F.lit("euclidean"),
            F.lit("random_state"), (F.col("label") + 42).cast("string"),
        ).alias("params"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    name = (
        F.when(v % 41 == 0, F.lit(None).cast("string")).when(v % 43 == 0, F.lit(""))
        .when(v % 10 == 9, F.concat(F.lit("img_"), (v - 1).cast("string")))
        .otherwise(F.concat(F.lit("img_"), v.cast("string")))
    )
    return table(spark, sf, "embeddings").select(
        (v + 1).alias("point_id"), name.alias("item_id"),
        F.concat(F.lit("NATION_"), F.col("label").cast("string")).alias("group_key"),
        F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"),
        _method().alias("method"), (F.col("label") + 1).cast("bigint").alias("config_id"),
    )


def viz(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("config_id")
    return runs(spark, sf).select(
        c.alias("viz_id"), "method", "config_id",
        F.concat(F.col("method"), F.lit("_"), c.cast("string"), F.lit(".avif")).alias("low_res"),
        F.concat(F.lit("2024-01-"), F.lpad(c.cast("string"), 2, "0")).alias("created_at"),
    )


def viz_points(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select(
        F.col("config_id").alias("viz_id"), "point_id",
        F.bround((F.col("x") + 1) / 2 * 16383).cast("int").alias("viz_x"),
        F.bround((F.col("y") + 1) / 2 * 16383).cast("int").alias("viz_y"),
    )


# --- A larger set of plane points: one per order.

ORDER_POINTS = """
op AS (SELECT o_orderkey AS point_id, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, o_orderstatus AS group_key FROM orders),
ext AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM op),
canvas AS (SELECT point_id, group_key, x, y,
   CAST(round_even((x - min_x) / (CASE WHEN max_x = min_x THEN 1 ELSE max_x - min_x END) * 16383, 0) AS INTEGER) AS viz_x,
   CAST(round_even((y - min_y) / (CASE WHEN max_y = min_y THEN 1 ELSE max_y - min_y END) * 16383, 0) AS INTEGER) AS viz_y
   FROM op, ext)
"""


def order_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("point_id"), F.col("o_totalprice").alias("x"),
        F.col("o_custkey").cast("double").alias("y"), F.col("o_orderstatus").alias("group_key"),
    )
