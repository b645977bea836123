"""Stored runs, sweeps and the streaming form."""

from __future__ import annotations

from pyspark.sql import functions as F

from planisphere.functions.canvas import canvas_normalise
from planisphere.functions.vectors import doubles
from planisphere.methods.linear import place
from planisphere.operators.lookups import attach_coords, points_for_run
from planisphere.operators.subset import fetch_subset
from planisphere.runs import run_reduction, sweep, visualise
from planisphere.plans.base import folder, query, r6, table, vectors
from planisphere.plans.linear_queries import PCA_SQL, placed
from planisphere.registry import RunConfig, run_method
from planisphere.sources.catalog import Catalog
from planisphere.streaming.moments_stream import MomentStream

FIRST5 = """sub AS (SELECT vec_id, label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 5)"""


def _on_subset(sql: str) -> str:
    return sql.replace("FROM embeddings", "FROM sub").replace("JOIN embeddings", "JOIN sub").replace("WITH RECURSIVE", f"WITH RECURSIVE {FIRST5},")


PLACED = f"""p AS ({_on_subset(PCA_SQL).replace(', 6)', ', 12)')}), e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM p)"""
CANVAS = """CAST(round_even((x - a) / (b - a) * 16383, 0) AS INTEGER) AS viz_x, CAST(round_even((y - c) / (d - c) * 16383, 0) AS INTEGER) AS viz_y"""


@query("first_map", f"WITH {PLACED} SELECT item_id, group_key, {CANVAS}, true AS all_unique FROM p, e")
def q_first_map(spark, sf):
    """First five per label, placed by PCA on the canvas, with the uniqueness of every item checked."""
    sub = fetch_subset(vectors(spark, sf), "artist_first5", 250)
    coords = run_method(sub, "pca").drop("group_key")
    canvas = canvas_normalise(attach_coords(sub.select("item_id", "group_key"), coords))
    counts = canvas.groupBy("item_id").count().agg((F.max("count") == 1).alias("u")).scalar()
    return canvas.select("item_id", "group_key", "viz_x", "viz_y", counts.alias("all_unique"))


@query("run_reduction", f"""SELECT CAST(row_number() OVER (ORDER BY CAST(item_id AS BIGINT)) AS BIGINT) AS point_id, CAST(item_id AS VARCHAR) AS item_id,
  CAST(group_key AS VARCHAR) AS group_key, x, y FROM ({_on_subset(PCA_SQL)})""")
def q_run(spark, sf):
    catalog = Catalog(spark, folder(spark, "catalog"))
    config_id = run_reduction(catalog, vectors(spark, sf), RunConfig("pca"))
    found = points_for_run(catalog.read("points"), "pca", config_id)
    return found.select("point_id", "item_id", "group_key", r6("x").alias("x"), r6("y").alias("y"))


SWEEP = [
    RunConfig("pca", "all", subset_strategy="random", subset_size=10**9), RunConfig("pca", "five"), RunConfig("svd", "five"),
    RunConfig("grp", "five"), RunConfig("grp", "again"), RunConfig("tsimcne", "basic"),
]


@query("sweep", f"""WITH {FIRST5}, a AS (SELECT count(*) AS n FROM embeddings), f AS (SELECT count(*) AS n FROM sub)
  SELECT 'pca' AS method, 'all' AS name, 1::BIGINT AS config_id, 'stored' AS outcome, n AS points FROM a
  UNION ALL SELECT 'pca', 'five', 2, 'stored', n FROM f UNION ALL SELECT 'svd', 'five', 1, 'stored', n FROM f
  UNION ALL SELECT 'grp', 'five', 1, 'stored', n FROM f UNION ALL SELECT 'grp', 'again', 1, 'stored', n FROM f
  UNION ALL SELECT 'tsimcne', 'basic', NULL, 'not supported', 0""")
def q_sweep(spark, sf):
    catalog = Catalog(spark, folder(spark, "catalog"))
    done = sweep(catalog, vectors(spark, sf), SWEEP)
    counts = catalog.read("points").groupBy("method", "config_id").agg(F.count(F.lit(1)).alias("points"))
    return done.join(counts, ["method", "config_id"], "left").select("method", "name", "config_id", "outcome", F.coalesce("points", F.lit(0)).alias("points"))


@query("visualise", f"""WITH {PLACED} SELECT CAST(row_number() OVER (ORDER BY CAST(item_id AS BIGINT)) AS BIGINT) AS point_id,
  {CANVAS}, 1::BIGINT AS viz_id FROM p, e""")
def q_visualise(spark, sf):
    catalog = Catalog(spark, folder(spark, "catalog"))
    viz_id = visualise(catalog, "pca", run_reduction(catalog, vectors(spark, sf), RunConfig("pca")))
    return catalog.read("viz_points").filter(F.col("viz_id") == viz_id)


@query("ipca_stream", PCA_SQL)
def q_stream(spark, sf):
    """The vectors arrive as a stream of files; the merged moments place all rows."""
    source = table(spark, sf, "embeddings")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/embeddings.parque[t]").select(doubles(F.col("embedding")).alias("embedding"))
    state = MomentStream(spark, folder(spark, "moments"))
    state.run(stream, folder(spark, "offsets")).awaitTermination()
    return placed(place(vectors(spark, sf), state.model(2).apply))
