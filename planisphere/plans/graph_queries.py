"""Graph embeddings and distance-scaling maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from planisphere.methods import graph as G
from planisphere.methods import stress as S
from planisphere.methods.linear import place
from planisphere.operators.graph import Links, barycentre_weights, components, geodesics, neighbours, product
from planisphere.operators.knn import symmetrise
from planisphere.plans.base import query, r6, related, vectors
from planisphere.plans.linear_queries import COUNT, finite, _falling, cert, near_zero
from planisphere.plans.neighbour_queries import knn_cte
from planisphere.registry import run_method, typed_params
from planisphere.session import cut

NODES = "node AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS node FROM embeddings)"


def edge_cte(k: int) -> str:
    """Both directions of the k-neighbour graph on node numbers with the distance as weight."""
    return f"""{knn_cte(k)}, {NODES},
  directed AS (SELECT s.node AS src, d.node AS dst, dist FROM knn JOIN node s ON s.vec_id = src JOIN node d ON d.vec_id = dst),
  edge AS (SELECT src, dst, min(dist) AS w FROM (SELECT src, dst, dist FROM directed UNION ALL SELECT dst, src, dist FROM directed) GROUP BY ALL)"""


@query("degrees", f"""WITH {edge_cte(9)} SELECT src AS node, CAST(count(*) FILTER (b = 2) + 0.5 * count(*) FILTER (b = 1) AS DOUBLE) AS deg
  FROM (SELECT src, dst, count(*) AS b FROM (SELECT src, dst FROM directed UNION ALL SELECT dst, src FROM directed) GROUP BY ALL) GROUP BY src""")
def q_degrees(spark, sf):
    nb = neighbours(vectors(spark, sf), 9)
    a = symmetrise(nb.knn.select("src", "dst", F.lit(1.0).alias("w")), "mean")
    return a.groupBy(F.col("src").alias("node")).agg(r6(F.sum("w")).alias("deg"))


@query("components", f"""WITH RECURSIVE {edge_cte(2)}, reach(node, comp) AS (SELECT node, node FROM node UNION
  SELECT edge.dst, reach.comp FROM reach JOIN edge ON edge.src = reach.node) SELECT node, min(comp) AS comp FROM reach GROUP BY node""")
def q_components(spark, sf):
    nb = neighbours(vectors(spark, sf), 2)
    links = Links(G.undirected(nb), nb.n)
    return components(links, nb.nodes)


@query("geodesics", f"""WITH RECURSIVE {edge_cte(5)},
  mark AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS mark FROM node WHERE node IN (0, 7, 49, 343)),
  path AS (SELECT 0 AS hop, node, mark, 0.0::DOUBLE AS dist FROM mark
    UNION ALL SELECT hop + 1, node, mark, min(dist) FROM (
      SELECT hop, dst AS node, mark, dist + w AS dist FROM path JOIN edge ON src = path.node WHERE hop < 25
      UNION ALL SELECT hop, node, mark, dist FROM path WHERE hop < 25) GROUP BY hop, node, mark)
  SELECT node, CAST(mark AS INTEGER) AS mark, round(dist, 6) + 0.0 AS dist FROM path WHERE hop = 25""")
def q_geodesics(spark, sf):
    nb = neighbours(vectors(spark, sf), 5)
    return geodesics(Links(G.undirected(nb), nb.n), [0, 7, 49, 343]).select("node", "mark", r6("dist").alias("dist"))


@query("isomap", f"{COUNT}, true AS centred, true AS related FROM embeddings")
def q_isomap(spark, sf):
    """The map of n landmarks is centred; with fewer the centre stays near the origin."""
    v = vectors(spark, sf)
    made = cut(run_method(v, "isomap"))
    spread = F.sqrt(F.var_pop("x") + F.var_pop("y"))
    return cert(made, n=F.count(F.lit(1)), finite=finite(), related=related(made, v), centred=(F.abs(F.avg("x")) < spread) & (F.abs(F.avg("y")) < spread))


@query("lle_weights", """SELECT vec_id AS item_id, 15::BIGINT AS k, 1.0::DOUBLE AS total FROM embeddings""")
def q_lle_weights(spark, sf):
    nb = neighbours(vectors(spark, sf), 15)
    w = barycentre_weights(nb).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"), r6(F.sum("w")).alias("total"))
    return nb.nodes.select("node", "item_id").join(w, "node").select("item_id", "k", "total")


def _orthonormal(made):
    """Unit length, mutually orthogonal, orthogonal to the constant."""
    return {"n": F.count(F.lit(1)), "finite": finite(),
            "unit": near_zero(F.sum(F.col("x") * F.col("x")) - 1, 1e-6) & near_zero(F.sum(F.col("y") * F.col("y")) - 1, 1e-6),
            "orthogonal": near_zero(F.sum(F.col("x") * F.col("y"))) & near_zero(F.sum("x")) & near_zero(F.sum("y"))}


def _low_energy(weights, made):
    """Whether the weights rebuild the map far better than they rebuild values without relation to them.

    The energy of a unit vector is on average the trace over n: one, and the sum of squared weights over n.
    """
    links = Links(weights, made.count(), 32)
    back = made.selectExpr("node AS i", "x AS v0", "y AS v1").withColumnRenamed("i", "node")
    rebuilt = back.join(product(links, back, 2), "node", "left")
    row = rebuilt.selectExpr("sum(pow(v0 - coalesce(a0, 0), 2)) / sum(v0 * v0) AS x", "sum(pow(v1 - coalesce(a1, 0), 2)) / sum(v1 * v1) AS y", "count(*) AS n").first()
    trace = 1 + weights.agg(F.sum(F.col("w") * F.col("w"))).first()[0] / row["n"]
    links.close()
    return F.lit(max(row["x"], row["y"]) <= 0.35 * trace)


def _local_linear(name, spark, sf):
    """A map by its own weights, at the method's own settings: orthonormal, and rebuilt by the weights."""
    params = typed_params(name)
    made, weights = (G.fit_lle if name == "lle" else G.fit_glle)(vectors(spark, sf), params)
    made = cut(made)
    return cert(made, **_orthonormal(made), low_energy=_low_energy(weights, made))


@query("lle", f"{COUNT}, true AS unit, true AS orthogonal, true AS low_energy FROM embeddings")
def q_lle(spark, sf):
    return _local_linear("lle", spark, sf)


@query("spectral", f"{COUNT}, true AS small_residual, true AS weighted_centre FROM embeddings")
def q_spectral(spark, sf):
    """Residuals of both eigenpairs, and orthogonality to the trivial vector under the degrees."""
    v = vectors(spark, sf)
    params = typed_params("spectral")
    nb = neighbours(v, params["n_neighbors"] - 1)
    found, degrees = G.fit_spectral(nb, params)
    both = found.vectors.join(degrees, "node").select("deg", F.col("v0").alias("x"), F.col("v1").alias("y"))
    return cert(both, n=F.count(F.lit(1)), finite=finite(), small_residual=F.lit(found.converged(params["tol"])),
                weighted_centre=near_zero(F.sum(F.col("x") * F.sqrt("deg"))) & near_zero(F.sum(F.col("y") * F.sqrt("deg"))))


@query("glle", f"{COUNT}, true AS unit, true AS orthogonal, true AS low_energy FROM embeddings")
def q_glle(spark, sf):
    return _local_linear("glle", spark, sf)


@query("phate_kernel", f"""WITH {edge_cte(1_000_000)}, eps AS (SELECT s.node, dist AS eps FROM knn JOIN node s ON s.vec_id = src WHERE rank = 5),
  k AS (SELECT src, dst, 0.5 * exp(-pow(w / a.eps, 40)) + 0.5 * exp(-pow(w / b.eps, 40)) AS w FROM edge JOIN eps a ON a.node = src JOIN eps b ON b.node = dst)
  SELECT src, dst, round(w, 6) + 0.0 AS w FROM k WHERE w >= 1e-4 UNION ALL SELECT node, node, 1.0 FROM node""")
def q_phate_kernel(spark, sf):
    nb = G.kernel_neighbours(vectors(spark, sf), 5, 40.0)
    return G.decay_kernel(nb, 5, 40.0).select("src", "dst", r6("w").alias("w"))


@query("phate", f"{COUNT}, true AS spread, true AS related FROM embeddings")
def q_phate(spark, sf):
    v = vectors(spark, sf)
    made = cut(run_method(v, "phate"))
    return cert(made, n=F.count(F.lit(1)), finite=finite(), related=related(made, v), spread=(F.var_pop("x") > 0) & (F.var_pop("y") > 0))


# --- stress

@query("mds", f"{COUNT}, true AS falling FROM embeddings")
def q_mds(spark, sf):
    v = vectors(spark, sf)
    run, history = S.fit_mds(v, typed_params("mds"))
    return cert(place(v, run), n=F.count(F.lit(1)), finite=finite(), falling=F.lit(_falling(history)))


@query("mds_nonmetric", f"{COUNT}, true AS falling, true AS related FROM embeddings")
def q_mds_ranks(spark, sf):
    """Only the order of the distances counts: the stress of the ranks falls, and the map has to do with the vectors."""
    v = vectors(spark, sf)
    run, history = S.fit_mds(v, typed_params("mds", {"metric": False, "landmarks": 200, "n_init": 1}))
    made = cut(place(v, run))
    return cert(made, n=F.count(F.lit(1)), finite=finite(), falling=F.lit(_falling(history)), related=related(made, v))


@query("sammon_random", f"{COUNT}, true AS falling FROM embeddings")
def q_sammon(spark, sf):
    v = vectors(spark, sf)
    run, history = S.fit_sammon(v, typed_params("sammon_random"))
    return cert(place(v, run), n=F.count(F.lit(1)), finite=finite(), falling=F.lit(_falling(history)))


@query("clmds", f"{COUNT}, true AS spread, true AS related FROM embeddings")
def q_clmds(spark, sf):
    v = vectors(spark, sf)
    made = cut(run_method(v, "clmds"))
    return cert(made, n=F.count(F.lit(1)), finite=finite(), related=related(made, v), spread=(F.var_pop("x") > 0) & (F.var_pop("y") > 0))
