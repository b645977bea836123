"""Neighbour joins, landmark choice and seeded pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planisphere.operators.knn import knn_cells, knn_descent, knn_exact, knn_forest, knn_recall, symmetrise
from planisphere.operators.pairs import ROUNDS, landmarks_maxmin, number_nodes, random_pairs
from planisphere.operators.subset import landmarks_random
from planisphere.plans.base import query, r6, vectors

K = 10


def knn_cte(k: int = K, metric: str = "list_distance(a.e, b.e)", include_self: bool = False) -> str:
    return f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
knn AS (SELECT src, rank, dst, dist FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {metric} AS dist,
   row_number() OVER (PARTITION BY a.vec_id ORDER BY {metric}, b.vec_id) AS rank
   FROM e a JOIN e b ON {'true' if include_self else 'a.vec_id <> b.vec_id'}) WHERE rank <= {k})"""


OUT = "SELECT src, CAST(rank AS INTEGER) AS rank, dst, round(dist, 6) + 0.0 AS dist FROM knn"


def _out(df):
    return df.select("src", "rank", "dst", r6("dist").alias("dist"))


@query("knn_exact", f"WITH {knn_cte()} {OUT}")
def q_exact(spark, sf):
    return _out(knn_exact(vectors(spark, sf), K))


@query("knn_exact_self", f"WITH {knn_cte(6, include_self=True)} {OUT}")
def q_exact_self(spark, sf):
    """Six neighbours, the row itself among them, over a grid of block pairs."""
    return _out(knn_exact(vectors(spark, sf), 6, include_self=True, blocks=3))


@query("knn_cosine", f"WITH {knn_cte(K, 'list_cosine_distance(a.e, b.e)')} {OUT}")
def q_cosine(spark, sf):
    return _out(knn_exact(vectors(spark, sf), K, metric="cosine"))


@query("knn_manhattan", f"""WITH {knn_cte(K, 'list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2])))')} {OUT}""")
def q_manhattan(spark, sf):
    return _out(knn_exact(vectors(spark, sf), K, metric="manhattan"))


@query("knn_approx", f"WITH {knn_cte()} {OUT}")
def q_cells(spark, sf):
    """With every cell probed the cell join is exact."""
    return _out(knn_cells(vectors(spark, sf), K, cells=8, probes=8, block_rows=200))


@query("knn_recall", """SELECT * FROM (SELECT 'cells' AS backend, count(*) AS sources, true AS good FROM embeddings
  UNION ALL SELECT 'forest', count(*), true FROM embeddings UNION ALL SELECT 'descent', count(*), true FROM embeddings)""")
def q_recall(spark, sf):
    """Mean recall of the approximate joins against the exact one; the descent finds all but a twentieth at its defaults."""
    v = vectors(spark, sf)
    truth = knn_exact(v, K).persist()
    cells = knn_recall(truth, knn_cells(v, K, cells=8, probes=4), K)
    forest = knn_recall(truth, knn_forest(v, K, trees=30), K)
    descent = knn_recall(truth, knn_descent(v, K), K)
    parts = [
        found.agg(F.count(F.lit(1)).alias("sources"), (F.avg("recall") >= least).alias("good")).select(F.lit(name).alias("backend"), "sources", "good")
        for name, found, least in (("cells", cells, 0.6), ("forest", forest, 0.6), ("descent", descent, 0.95))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("knn_descent", "SELECT vec_id AS src, 10::BIGINT AS listed, 10::BIGINT AS ranks, true AS rising, true AS others FROM embeddings")
def q_descent(spark, sf):
    """Ten different neighbours of every row by rising distance, none of them the row itself."""
    w = Window.partitionBy("src").orderBy("rank")
    found = knn_descent(vectors(spark, sf), K).withColumn("_before", F.lag("dist").over(w))
    return found.groupBy("src").agg(F.count_distinct("dst").alias("listed"), F.count_distinct("rank").alias("ranks"),
                                    F.min(F.coalesce(F.col("dist") >= F.col("_before"), F.lit(True))).alias("rising"), F.min(F.col("dst") != F.col("src")).alias("others"))


@query("symmetrise", f"""WITH {knn_cte()}, w AS (SELECT src, dst, exp(-dist) AS w FROM knn),
  b AS (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w)
  SELECT src, dst, round(max(w), 6) AS max_w, round(sum(w) / 2, 6) AS mean_w,
  round(CASE WHEN count(*) = 2 THEN sum(w) - min(w) * max(w) ELSE sum(w) END, 6) AS fuzzy_w FROM b GROUP BY src, dst""")
def q_symmetrise(spark, sf):
    e = knn_exact(vectors(spark, sf), K).select("src", "dst", F.exp(-F.col("dist")).alias("w")).persist()
    out = None
    for how in ("max", "mean", "fuzzy"):
        part = symmetrise(e, how).select("src", "dst", r6("w").alias(f"{how}_w"))
        out = part if out is None else out.join(part, ["src", "dst"])
    return out


@query("landmarks", "SELECT vec_id AS item_id, label AS group_key FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 64")
def q_landmarks(spark, sf):
    return landmarks_random(vectors(spark, sf).drop("embedding"), "item_id", 64, 7)


@query("landmarks_maxmin", """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  pick AS (SELECT 0 AS pick, vec_id, [e] AS chosen FROM (SELECT * FROM e ORDER BY md5('7:' || vec_id), vec_id LIMIT 1)
  UNION ALL SELECT p + 1, best.vec_id, list_append(ch, best.e) FROM (
    SELECT any_value(pick.pick) AS p, any_value(pick.chosen) AS ch, arg_max(struct_pack(vec_id := e.vec_id, e := e.e),
      struct_pack(g := round(list_min(list_transform(pick.chosen, lambda c: list_distance(c, e.e))), 12), i := -e.vec_id)) AS best
    FROM pick, e WHERE pick.pick < 7 HAVING count(*) > 0))
  SELECT CAST(pick AS INTEGER) AS pick, vec_id AS item_id FROM pick""")
def q_maxmin(spark, sf):
    return landmarks_maxmin(vectors(spark, sf), 8, seed=7).select("pick", "item_id")


def _u(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


@query("pseudo_random_pairs", f"""WITH {knn_cte()}, n AS (SELECT count(*) AS n FROM embeddings),
  node AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS node FROM embeddings),
  near AS (SELECT s.node AS src, d.node AS dst FROM knn JOIN node s ON s.vec_id = src JOIN node d ON d.vec_id = dst),
  out AS (SELECT node AS src, list_sort(list_append(coalesce(o, []), node)) AS out FROM node LEFT JOIN (SELECT src, list(dst) AS o FROM near GROUP BY src) ON src = node),
  keyed AS (SELECT src, out, n - len(out) AS size, list_transform(range({ROUNDS}), lambda r: CAST(floor({_u("src || ':k:' || r")} * (n - len(out))) AS BIGINT)) AS keys FROM out, n),
  placed AS (SELECT src, out, slot, list_reduce(list_concat([slot], range({ROUNDS})), lambda x, r: CASE
      WHEN {_u("src || ':' || r || ':' || greatest(x, (keys[r + 1] - x + size) % size)")} < 0.5 THEN (keys[r + 1] - x + size) % size ELSE x END) AS place
    FROM keyed, (SELECT unnest(range(4)) AS slot))
  SELECT src, CAST(slot AS INTEGER) AS slot, list_reduce(list_concat([place], out), lambda v, o: CASE WHEN o <= v THEN v + 1 ELSE v END) AS dst FROM placed""")
def q_pairs(spark, sf):
    nodes = number_nodes(vectors(spark, sf)).persist()
    near = knn_exact(nodes, K, key="node")
    return random_pairs(nodes, nodes.count(), 4, 42, avoid=near)
