"""Sources, catalogue, lookups, joins, aggregates and canvas queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from planisphere.functions import canvas as C
from planisphere.functions.seeded import u01
from planisphere.operators import lookups, quality, subset
from planisphere.plans.base import CTE, ORDER_POINTS, folder, order_points, points, query, r6, runs, table, vectors, viz, viz_points
from planisphere.sources import catalog
from planisphere.sources.embeddings import decode_blob, encode_blob, ingest_ignore, scan_embeddings

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("scan_embeddings", """
SELECT vec_id AS item_id, label AS group_key, CAST(len(embedding) AS INTEGER) AS dim,
       round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings""")
def q_scan(spark, sf):
    df = scan_embeddings(spark, f"{sf}/embeddings.parquet")
    return df.select("item_id", "group_key", F.size("embedding").alias("dim"),
                     r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("decode_blob", """
SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS bytes, CAST(len(embedding) AS INTEGER) AS dim,
       round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS head, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) + 0.0 AS tail,
       true AS same FROM embeddings""")
def q_blob(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("embedding").alias("original"))
    blobs = encode_blob(df).withColumn("bytes", F.octet_length("embedding"))
    back = decode_blob(blobs)
    e = F.col("embedding")
    return back.select("vec_id", "bytes", F.size(e).alias("dim"), r6(e[0].cast("double")).alias("head"),
                       r6(F.element_at(e, -1).cast("double")).alias("tail"), (e == F.col("original")).alias("same"))


@query("ingest_ignore", """
WITH existing AS (SELECT vec_id FROM embeddings WHERE label < 5),
incoming AS (SELECT vec_id, label, 2 * vec_id AS arrival FROM embeddings
             UNION ALL SELECT vec_id, label + 100, 2 * vec_id + 1 - 2 * (vec_id % 2) AS arrival FROM embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY arrival) AS rn FROM incoming)
SELECT vec_id, label, arrival FROM ranked WHERE rn = 1 AND vec_id NOT IN (SELECT vec_id FROM existing)""")
def q_ingest(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "label")
    v = F.col("vec_id")
    incoming = df.withColumn("arrival", 2 * v).unionByName(
        df.select("vec_id", (F.col("label") + 100).alias("label"), (2 * v + 1 - 2 * (v % 2)).alias("arrival")))
    return ingest_ignore(df.filter(F.col("label") < 5), incoming, "vec_id", "arrival")


@query("save_points", """
SELECT 1000 + row_number() OVER (ORDER BY vec_id) AS point_id, CAST(vec_id AS VARCHAR) AS item_id,
       CAST(label AS VARCHAR) AS group_key, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS x,
       round(CAST(embedding[2] AS DOUBLE), 6) + 0.0 AS y, 'pca' AS method, CAST(7 AS BIGINT) AS config_id FROM embeddings""")
def q_save_points(spark, sf):
    coords = vectors(spark, sf).select("item_id", "group_key", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    kept = catalog.Catalog(spark, folder(spark, "catalog"))
    kept.save_points(coords, "pca", 7, above=1000)
    return kept.read("points").withColumns({"x": r6("x"), "y": r6("y")})


@query("save_viz", f"WITH {ORDER_POINTS} SELECT CAST(11 AS BIGINT) AS viz_id, point_id, viz_x, viz_y FROM canvas")
def q_save_viz(spark, sf):
    kept, viz_id = _pictured(spark, sf)
    return kept.read("viz_points").filter(F.col("viz_id") == viz_id).select("viz_id", "point_id", "viz_x", "viz_y")


def _pictured(spark, sf):
    """A catalogue that already lists visualisations, and one more of all orders; its id."""
    kept = catalog.Catalog(spark, folder(spark, "catalog"))
    kept.write_version("viz", _stored_viz(spark, sf))
    return kept, kept.save_viz("pca", 1, "pca_1.avif", C.canvas_normalise(order_points(spark, sf)), "orders")


def _stored_viz(spark, sf):
    return viz(spark, sf).select("viz_id", "method", "config_id", "low_res", F.lit("").alias("caption"), F.lit(1.0).alias("scale"), F.to_timestamp("created_at").alias("created_at"))


@query("viz_point_ids", """WITH p AS (SELECT o_orderkey AS point_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 65536 AS chunk FROM orders)
SELECT CAST(11 AS BIGINT) AS viz_id, CAST(chunk AS INTEGER) AS chunk, list(point_id ORDER BY point_id) AS point_ids, 'orders' AS caption FROM p GROUP BY chunk""")
def q_viz_ids(spark, sf):
    """The ordered ids that a stored visualisation keeps, in arrays of bounded length, beside its caption."""
    kept, viz_id = _pictured(spark, sf)
    listed = kept.read("viz_ids").filter(F.col("viz_id") == viz_id)
    return listed.join(F.broadcast(kept.read("viz").filter(F.col("viz_id") == viz_id).select("viz_id", "caption")), "viz_id").select("viz_id", "chunk", "point_ids", "caption")


@query("update_viz_image", f"""WITH {CTE} SELECT viz_id, method, config_id,
  CASE WHEN viz_id = 4 THEN 'new.avif' ELSE low_res END AS low_res, created_at FROM viz""")
def q_update_image(spark, sf):
    kept = catalog.Catalog(spark, folder(spark, "catalog"))
    kept.write_version("viz", _stored_viz(spark, sf))
    kept.update_viz_image(4, "new.avif")
    return kept.read("viz").select("viz_id", "method", "config_id", "low_res", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


# --- lookups

@query("configs_for_method", f"""WITH {CTE} SELECT config_id, subset_strategy, subset_size, runtime, n_neighbors,
  CAST(NULL AS DOUBLE) AS min_dist, CAST(NULL AS DOUBLE) AS spread, CAST(NULL AS DOUBLE) AS set_op_mix_ratio,
  CAST(NULL AS DOUBLE) AS local_connectivity, CAST(2 AS INTEGER) AS n_components, 'euclidean' AS metric, random_state
  FROM runs WHERE method = 'umap' ORDER BY config_id DESC""")
def q_configs(spark, sf):
    return lookups.configs_for_method(runs(spark, sf), "umap")


@query("config_by_id", f"""WITH {CTE} SELECT config_id, subset_strategy, subset_size, runtime,
  CAST(2 AS INTEGER) AS n_components, random_state FROM runs WHERE method = 'pca' AND config_id = 4""")
def q_config(spark, sf):
    return lookups.config_by_id(runs(spark, sf), "pca", 4)


@query("points_for_run", f"""WITH {CTE} SELECT point_id, item_id, group_key, x, y FROM points WHERE method = 'umap' AND config_id = 5""")
def q_points(spark, sf):
    return lookups.points_for_run(points(spark, sf), "umap", 5)


@query("viz_list", f"WITH {CTE} SELECT viz_id, method, config_id, low_res, created_at FROM viz ORDER BY viz_id DESC")
def q_viz_list(spark, sf):
    return lookups.viz_list(viz(spark, sf))


@query("viz_by_id", f"WITH {CTE} SELECT viz_id, method, config_id, low_res, created_at FROM viz WHERE viz_id = 3")
def q_viz(spark, sf):
    return lookups.viz_by_id(viz(spark, sf), 3)


@query("viz_points_by_id", f"""WITH {CTE} SELECT v.point_id, v.viz_id, viz_x, viz_y, item_id, group_key
  FROM viz_points v LEFT JOIN points p ON v.point_id = p.point_id WHERE viz_id = 3""")
def q_viz_points(spark, sf):
    return lookups.viz_points_by_id(viz_points(spark, sf), points(spark, sf), 3, viz(spark, sf))


@query("artists_all", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS nationality FROM nation")
def q_artists(spark, sf):
    return lookups.artists_all(_artists(spark, sf))


def _artists(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("nationality"))


@query("require_2d", """SELECT vec_id AS item_id, CAST(CASE WHEN vec_id % 5 = 0 THEN 3 ELSE 1 END AS INTEGER) AS components
  FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0""")
def q_2d(spark, sf):
    v = F.col("item_id")
    width = F.when(v % 5 == 0, 3).when(v % 7 == 0, 1).otherwise(2)
    made = vectors(spark, sf).select("item_id", F.slice("embedding", F.lit(1), width).alias("coords"))
    return quality.require_2d(made).select("item_id", F.size("coords").alias("components"))


@query("missing_names", f"WITH {CTE} SELECT point_id, item_id, group_key FROM points WHERE item_id IS NOT NULL AND item_id <> ''")
def q_names(spark, sf):
    return quality.missing_names(points(spark, sf)).select("point_id", "item_id", "group_key")


# --- joins

@query("attach_coords", """SELECT vec_id AS item_id, label AS group_key, CAST(embedding[1] AS DOUBLE) AS x,
  CAST(embedding[2] AS DOUBLE) AS y FROM embeddings""")
def q_attach_coords(spark, sf):
    v = vectors(spark, sf)
    coords = v.select("item_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return lookups.attach_coords(v.select("item_id", "group_key"), coords)


@query("attach_artist", f"""WITH {CTE},
  names AS (SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS nationality FROM nation WHERE n_nationkey % 4 <> 3)
  SELECT point_id, group_key, nationality FROM points LEFT JOIN names ON name = group_key""")
def q_attach_artist(spark, sf):
    some = table(spark, sf, "nation").filter(F.col("n_nationkey") % 4 != 3)
    artists = some.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("nationality"))
    return lookups.attach_artist(points(spark, sf).select("point_id", "group_key"), artists)


@query("missing_assets", f"""WITH {CTE} SELECT point_id, item_id FROM points p
  WHERE NOT EXISTS (SELECT 1 FROM labels WHERE 'img_' || doc_id = p.item_id)""")
def q_assets(spark, sf):
    assets = table(spark, sf, "labels").select(F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("item_id"))
    return quality.missing_assets(points(spark, sf), assets).select("point_id", "item_id")


@query("hit_test", f"""WITH {ORDER_POINTS},
clicks AS (SELECT event_id AS click_id, ((event_id * 7919) % 4096) + 10.0 - 10.0 AS sx, ((event_id * 104729) % 4096) + value - 5.0 AS sy FROM events),
spot AS (SELECT click_id, sx / 0.25 AS cx, sy / 0.25 AS cy FROM clicks)
SELECT click_id, min(point_id) AS point_id FROM spot LEFT JOIN canvas
  ON cx >= viz_x - 37.5 - 20 AND cx <= viz_x + 37.5 + 20 AND cy >= viz_y - 37.5 - 20 AND cy <= viz_y + 37.5 + 20
GROUP BY click_id""")
def q_hit(spark, sf):
    boxes = C.bounds_box(C.canvas_normalise(order_points(spark, sf)), "viz_x", "viz_y")
    e = F.col("event_id")
    clicks = table(spark, sf, "events").select(
        e.alias("click_id"), (F.pmod(e * 7919, F.lit(4096)) + F.lit(10.0)).alias("client_x"),
        (F.pmod(e * 104729, F.lit(4096)) + F.col("value")).alias("client_y"))
    return lookups.hit_test(boxes, clicks, k=0.25, tx=10.0, ty=5.0)


@query("orphan_viz_points", f"""WITH {CTE}
  SELECT viz_id, point_id, 'point' AS missing FROM viz_points WHERE point_id NOT IN (SELECT point_id FROM points WHERE config_id <> 4)
  UNION ALL SELECT viz_id, point_id, 'viz' FROM viz_points WHERE viz_id NOT IN (SELECT viz_id FROM viz WHERE viz_id <> 8)""")
def q_orphans(spark, sf):
    return quality.orphan_viz_points(
        viz_points(spark, sf), points(spark, sf).filter(F.col("config_id") != 4), viz(spark, sf).filter(F.col("viz_id") != 8))


# --- aggregates

@query("table_counts", "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def q_counts(spark, sf):
    return quality.table_counts({t: table(spark, sf, t) for t in TABLES})


@query("dup_report", f"""WITH {CTE} SELECT count(*) AS total, count(DISTINCT item_id) AS unique_items FROM points
  WHERE method = 'umap' AND config_id = 5""")
def q_dup(spark, sf):
    return quality.dup_report(points(spark, sf), "umap", 5)


@query("dup_report_all", f"""WITH {CTE} SELECT method, config_id, count(*) AS total, count(DISTINCT item_id) AS unique_items
  FROM points GROUP BY ALL""")
def q_dup_all(spark, sf):
    return quality.dup_report_all(points(spark, sf))


@query("extent", f"WITH {ORDER_POINTS} SELECT min_x, max_x, min_y, max_y FROM ext")
def q_extent(spark, sf):
    return C.extent(order_points(spark, sf))


@query("vector_stats", """SELECT count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim,
  'float' AS dtype, CAST(min(list_min(embedding)) AS DOUBLE) AS min_value, CAST(max(list_max(embedding)) AS DOUBLE) AS max_value,
  bool_or(len(list_filter(embedding, lambda x: isnan(x))) > 0) AS has_nan, bool_or(len(list_filter(embedding, lambda x: isinf(x))) > 0) AS has_inf
  FROM embeddings""")
def q_stats(spark, sf):
    return quality.vector_stats(table(spark, sf, "embeddings"))


@query("matrix_min", "SELECT CAST(min(list_min(embedding)) AS DOUBLE) AS min_value FROM embeddings")
def q_min(spark, sf):
    return quality.matrix_min(table(spark, sf, "embeddings"))


@query("collect_ids", f"""WITH {CTE} SELECT viz_id, CAST(floor(point_id / 65536.0) AS BIGINT) AS chunk, CAST(count(*) AS INTEGER) AS n,
  md5(string_agg(CAST(point_id AS VARCHAR), ',' ORDER BY point_id)) AS ids FROM viz_points GROUP BY 1, 2""")
def q_collect(spark, sf):
    ids = quality.collect_ids(viz_points(spark, sf))
    return ids.select("viz_id", "chunk", F.size("point_ids").alias("n"),
                      F.md5(F.array_join(F.col("point_ids").cast("array<string>"), ",")).alias("ids"))


@query("run_coverage", f"""WITH {CTE}, got AS (SELECT method, config_id, group_key, count(*) AS c FROM points GROUP BY ALL),
  per AS (SELECT method, config_id, CAST(sum(c) AS BIGINT) AS points, count(*) AS groups, max(c) AS largest_group FROM got GROUP BY ALL)
  SELECT r.method, r.config_id, subset_size, coalesce(points, 0) AS points, coalesce(groups, 0) AS groups,
         coalesce(largest_group, 0) AS largest_group, coalesce(points, 0) >= subset_size AS complete
  FROM runs r LEFT JOIN per USING (method, config_id)""")
def q_coverage(spark, sf):
    return quality.run_coverage(points(spark, sf), runs(spark, sf))


# --- windows, samples, keys

@query("first_n_per_group", """SELECT vec_id AS item_id, label AS group_key, CAST(rn AS INTEGER) AS rn FROM
  (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 5""")
def q_first(spark, sf):
    return subset.first_n_per_group(vectors(spark, sf).drop("embedding"), "group_key", "item_id", 5)


@query("label_encode", """SELECT vec_id AS item_id, 'NATION_' || label AS name,
  dense_rank() OVER (ORDER BY 'NATION_' || label) - 1 AS y FROM embeddings""")
def q_encode(spark, sf):
    named = vectors(spark, sf).select("item_id", F.concat(F.lit("NATION_"), F.col("group_key").cast("string")).alias("name"))
    return subset.label_encode(named, "name")


@query("random_subset", """SELECT vec_id AS item_id, label AS group_key FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 150""")
def q_random(spark, sf):
    return subset.random_subset(vectors(spark, sf).drop("embedding"), "item_id", 150, 42)


@query("head_sample", "SELECT vec_id AS item_id, label AS group_key FROM embeddings ORDER BY vec_id LIMIT 100")
def q_head(spark, sf):
    return subset.head_sample(vectors(spark, sf).drop("embedding"), "item_id", 100)


@query("assign_ids", """SELECT o_orderkey, 499 + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id FROM orders""")
def q_ids(spark, sf):
    return subset.assign_ids(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "id", 500).drop("o_custkey")


@query("seeded_draws", "SELECT o_orderkey, ('0x' || substr(md5('42:' || o_orderkey || ':7'), 1, 8))::BIGINT / 4294967296.0 AS u FROM orders")
def q_draws(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", u01(42, F.col("o_orderkey"), 7).alias("u"))


# --- canvas

@query("canvas_normalise", f"WITH {ORDER_POINTS} SELECT point_id, group_key, x, y, viz_x, viz_y FROM canvas")
def q_canvas(spark, sf):
    return C.canvas_normalise(order_points(spark, sf))


@query("screen_scale", f"""WITH {ORDER_POINTS},
  s AS (SELECT point_id, (x - min_x) / (max_x - min_x) AS tx, (y - min_y) / (max_y - min_y) AS ty,
               (max_x - min_x) / (max_y - min_y) AS aspect FROM op, ext)
  SELECT point_id, round(40 + tx * 16304.0 * aspect, 6) AS full_x, round(40 + 16304.0 - ty * 16304.0, 6) AS full_y,
         round(40 + tx * 8112.0 * aspect, 6) AS split_x, round(40 + 8112.0 - ty * 8112.0, 6) AS split_y FROM s""")
def q_screen(spark, sf):
    s = C.screen_scale(order_points(spark, sf))
    return s.select("point_id", *[r6(c).alias(c) for c in ("full_x", "full_y", "split_x", "split_y")])


@query("bounds_box", f"""WITH {ORDER_POINTS} SELECT point_id, CAST(viz_x - 37.5 AS DOUBLE) AS box_x, CAST(viz_y - 37.5 AS DOUBLE) AS box_y,
  CAST(75 AS DOUBLE) AS box_w, CAST(75 AS DOUBLE) AS box_h FROM canvas""")
def q_box(spark, sf):
    return C.bounds_box(C.canvas_normalise(order_points(spark, sf)), "viz_x", "viz_y").select("point_id", "box_x", "box_y", "box_w", "box_h")


@query("viewport_query", f"""WITH {ORDER_POINTS} SELECT point_id, CAST((viz_x - 37.5) * 0.5 - 1000 AS DOUBLE) AS screen_x, CAST((viz_y - 37.5) * 0.5 - 2000 AS DOUBLE) AS screen_y FROM canvas
  WHERE viz_x - 37.5 <= 2920 / 0.5 AND viz_x + 37.5 >= 1000 / 0.5 AND viz_y - 37.5 <= 3080 / 0.5 AND viz_y + 37.5 >= 2000 / 0.5""")
def q_viewport(spark, sf):
    boxes = C.bounds_box(C.canvas_normalise(order_points(spark, sf)), "viz_x", "viz_y")
    return C.viewport_query(boxes, 1920, 1080, 0.5, -1000.0, -2000.0).select("point_id", "screen_x", "screen_y")


@query("thumb_scale", """SELECT o_orderstatus AS group_key, count(*) AS n,
  round(CASE WHEN count(*) > 4000 THEN sqrt(4000.0 / count(*)) ELSE 1.0 END, 6) AS scale FROM orders GROUP BY 1""")
def q_thumb(spark, sf):
    g = order_points(spark, sf).groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("scale", r6(C.thumb_scale(F.col("n"))))


@query("run_label", f"""WITH {CTE} SELECT config_id, 'PCA (config ' || config_id || '): subset_strategy=' || subset_strategy ||
  ', subset_size=' || subset_size || ', runtime=' || runtime || ', n_components=2, random_state=' || random_state AS label
  FROM runs WHERE method = 'pca'""")
def q_label(spark, sf):
    typed = lookups.configs_for_method(runs(spark, sf), "pca")
    keys = ["subset_strategy", "subset_size", "runtime", "n_components", "random_state"]
    return typed.select("config_id", C.run_label(typed, "pca", keys).alias("label"))


@query("mosaic_layout", f"""WITH {ORDER_POINTS} SELECT point_id, viz_x AS x0, viz_y AS y0,
  CAST(least(viz_x + greatest(floor(75 * sc), 1), 16384) AS INTEGER) AS x1, CAST(least(viz_y + greatest(floor(75 * sc), 1), 16384) AS INTEGER) AS y1
  FROM canvas, (SELECT CASE WHEN count(*) > 4000 THEN sqrt(4000.0 / count(*)) ELSE 1.0 END AS sc FROM op)""")
def q_mosaic(spark, sf):
    op = order_points(spark, sf)
    return lookups.mosaic_layout(C.canvas_normalise(op), _scale(op))


def _scale(op):
    return op.agg(F.count(F.lit(1)).alias("n")).select(C.thumb_scale(F.col("n"))).scalar()


@query("mosaic_top", f"""WITH {ORDER_POINTS}, lay AS (SELECT point_id, viz_x AS x0, viz_y AS y0,
  CAST(least(viz_x + greatest(floor(75 * sc), 1), 16384) AS INTEGER) AS x1, CAST(least(viz_y + greatest(floor(75 * sc), 1), 16384) AS INTEGER) AS y1
  FROM canvas, (SELECT CASE WHEN count(*) > 4000 THEN sqrt(4000.0 / count(*)) ELSE 1.0 END AS sc FROM op)),
  gx AS (SELECT *, unnest(range(x0 // 64, (x1 - 1) // 64 + 1)) AS cx FROM lay),
  gy AS (SELECT *, unnest(range(y0 // 64, (y1 - 1) // 64 + 1)) AS cy FROM gx)
  SELECT cx, cy, max(point_id) AS top_point FROM gy GROUP BY cx, cy""")
def q_mosaic_top(spark, sf):
    op = order_points(spark, sf)
    return lookups.mosaic_top(lookups.mosaic_layout(C.canvas_normalise(op), _scale(op)))


@query("density_tiles", f"""WITH {ORDER_POINTS}, zs AS (SELECT unnest([0, 2, 4, 6]) AS z)
  SELECT CAST(z AS INTEGER) AS z, CAST(viz_x >> (14 - z) AS INTEGER) AS tx, CAST(viz_y >> (14 - z) AS INTEGER) AS ty, count(*) AS n,
         min(point_id) AS first_point FROM canvas, zs GROUP BY 1, 2, 3""")
def q_tiles(spark, sf):
    return lookups.density_tiles(C.canvas_normalise(order_points(spark, sf)), [0, 2, 4, 6])


# --- catalogue updates

_INCOMING = """inc AS (SELECT method, subset_strategy, subset_size, runtime + 1 AS runtime, config_id AS arrival, label,
  CASE WHEN label % 2 = 0 THEN n_neighbors ELSE 99 END AS n_neighbors, random_state + 1000 AS random_state FROM runs)"""


def _incoming(spark, sf):
    r = runs(spark, sf)
    even = (F.col("config_id") - 1) % 2 == 0
    p = F.col("params")
    return r.select(
        "method", "config_id", "subset_strategy", "subset_size", (F.col("runtime") + 1).alias("runtime"),
        F.create_map(
            F.lit("n_components"), F.lit("2"),
            F.lit("n_neighbors"), F.when(even, p["n_neighbors"]).otherwise("99"),
            F.lit("metric"), F.lit("euclidean"),
            F.lit("random_state"), (p["random_state"].cast("int") + 1000).cast("string"),
        ).alias("params"), F.col("config_id").alias("arrival"))


def _upserted(df):
    return df.select("method", "config_id", "subset_strategy", "subset_size", r6("runtime").alias("runtime"),
                     F.col("params")["n_neighbors"].cast("int").alias("n_neighbors"),
                     F.col("params")["random_state"].cast("int").alias("random_state"))


def _upsert_sql(match: str) -> str:
    return f"""WITH {CTE}, {_INCOMING},
  m AS (SELECT r.config_id, i.arrival, i.runtime AS nr, i.random_state AS ns FROM runs r JOIN inc i ON r.method = i.method
        AND r.subset_strategy = i.subset_strategy AND r.subset_size = i.subset_size AND {match}),
  upd AS (SELECT method, r.config_id, subset_strategy, subset_size, coalesce(nr, runtime) AS runtime, n_neighbors,
          coalesce(ns, random_state) AS random_state FROM runs r LEFT JOIN m ON r.config_id = m.config_id),
  mx AS (SELECT method, max(config_id) AS top FROM runs GROUP BY method),
  ins AS (SELECT inc.method, top + row_number() OVER (PARTITION BY inc.method ORDER BY arrival) AS config_id, subset_strategy,
          subset_size, runtime, n_neighbors, random_state FROM inc JOIN mx ON mx.method = inc.method
          WHERE arrival NOT IN (SELECT arrival FROM m))
  SELECT method, config_id, subset_strategy, subset_size, round(runtime, 6) AS runtime, n_neighbors, random_state
  FROM (SELECT * FROM upd UNION ALL SELECT * FROM ins)"""


@query("upsert_run", _upsert_sql("r.n_neighbors IS NOT DISTINCT FROM i.n_neighbors"))
def q_upsert(spark, sf):
    return _upserted(catalog.upsert_runs(runs(spark, sf), _incoming(spark, sf)))


@query("upsert_run_reference", _upsert_sql("r.n_neighbors = i.n_neighbors"))
def q_upsert_ref(spark, sf):
    return _upserted(catalog.upsert_runs(runs(spark, sf), _incoming(spark, sf), mode="reference", listed=["n_neighbors", "n_components"]))


@query("replace_points", f"""WITH {CTE} SELECT point_id, item_id, group_key, x, y, method, config_id FROM points WHERE config_id <> 5
  UNION ALL SELECT point_id + 100000, 'item_' || point_id, group_key, y, x, method, config_id FROM points WHERE config_id = 5 AND x > 0""")
def q_replace(spark, sf):
    p = points(spark, sf)
    fresh = p.filter((F.col("config_id") == 5) & (F.col("x") > 0)).select(
        (F.col("point_id") + 100000).alias("point_id"), F.concat(F.lit("item_"), F.col("point_id").cast("string")).alias("item_id"),
        "group_key", F.col("y").alias("x"), F.col("x").alias("y"), "method", "config_id")
    kept = catalog.Catalog(spark, folder(spark, "catalog"))
    kept.write_partitions("points", p)
    kept.replace_points(fresh, "umap", 5)
    return kept.read("points")


@query("identity_collisions", f"""WITH {CTE}, c AS (SELECT method, 'cfg_' || label AS name, label % 2 AS g FROM runs)
  SELECT method, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM c GROUP BY method, g HAVING count(*) > 1""")
def q_collisions(spark, sf):
    label = F.col("config_id") - 1
    configs = runs(spark, sf).select(
        "method", F.concat(F.lit("cfg_"), label.cast("string")).alias("name"), F.lit("random").alias("subset_strategy"),
        F.lit(150).alias("subset_size"),
        F.create_map(F.lit("n_neighbors"), (label % 2).cast("string"), F.lit("random_state"), label.cast("string")).alias("params"))
    return catalog.identity_collisions(configs).drop("identity")


@query("runtime_report", f"""WITH {CTE} SELECT method, count(*) AS runs, min(runtime) AS min_runtime,
  round(avg(runtime), 6) AS avg_runtime, max(runtime) AS max_runtime FROM runs GROUP BY method""")
def q_runtime(spark, sf):
    return lookups.runtime_report(runs(spark, sf))
