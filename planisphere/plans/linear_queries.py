"""Vector preparation, moments and linear projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planisphere.functions.vectors import distance
from planisphere.methods import linear as L
from planisphere.operators import moments as M
from planisphere.operators.prepare import preprocess_pca
from planisphere.operators.tall import count_and_mean, range_svd
from planisphere.plans.base import query, r6, related, table, vectors
from planisphere.registry import run_method

# Long form of the vectors, column means, centred cells and the covariance matrix as one nested list.
CELLS = """
cells AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS j, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
mu AS (SELECT j, avg(v) AS m FROM cells GROUP BY j),
cen AS (SELECT vec_id, cells.j, v - m AS v FROM cells JOIN mu USING (j))"""


def _matrix(name: str, source: str, scale: str) -> str:
    return f"""
{name}_cells AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) / {scale} AS v FROM {source} a JOIN {source} b USING (vec_id) GROUP BY 1, 2),
{name} AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM {name}_cells GROUP BY i))"""


def _axis(step: int, start: str) -> str:
    """The top eigenvector of a symmetric matrix by repeated squaring, and the matrix without it."""
    trace = "list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))"
    return f"""
sq{step} AS (SELECT 0 AS s, m FROM {start} UNION ALL
  SELECT s + 1, list_transform(n, lambda r: list_transform(n, lambda c: list_inner_product(r, c)))
  FROM (SELECT s, list_transform(m, lambda r: list_transform(r, lambda c: c / {trace})) AS n FROM sq{step} WHERE s < 13)),
top{step} AS (SELECT m[b] AS r, m[b][b] AS d FROM (SELECT m, list_position(g, list_max(g)) AS b
  FROM (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS g FROM sq{step} WHERE s = 13))),
ax{step} AS (SELECT list_transform(r, lambda c: c / sqrt(d)) AS v FROM top{step}),
lam{step} AS (SELECT list_inner_product(list_transform(m, lambda r: list_inner_product(r, v)), v) AS l FROM {start}, ax{step}),
rest{step} AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m
  FROM {start}, ax{step}, lam{step})"""


def _place_sql(cells: str, digits: int = 6) -> str:
    return f"""
SELECT vec_id AS item_id, label AS group_key, round(list_inner_product(e, a.v), {digits}) + 0.0 AS x, round(list_inner_product(e, b.v), {digits}) + 0.0 AS y
FROM (SELECT vec_id, list(v ORDER BY j) AS e FROM {cells} GROUP BY vec_id) JOIN embeddings USING (vec_id), ax1 a, ax2 b"""


def _pca_sql(digits: int = 6) -> str:
    return f"WITH RECURSIVE {CELLS}, {_matrix('cov', 'cen', '(count(*) - 1)')}, {_axis(1, 'cov')}, {_axis(2, 'rest1')} {_place_sql('cen', digits)}"


PCA_SQL = _pca_sql()
SVD_SQL = f"WITH RECURSIVE {CELLS}, {_matrix('gram', 'cells', '1')}, {_axis(1, 'gram')}, {_axis(2, 'rest1')} {_place_sql('cells')}"


def placed(df: DataFrame) -> DataFrame:
    return df.select("item_id", "group_key", r6("x").alias("x"), r6("y").alias("y"))


def cert(df: DataFrame, **columns: Column) -> DataFrame:
    """One row of invariants of a map."""
    return df.agg(*[c.alias(n) for n, c in columns.items()])


def near_zero(c: Column, tol: float = 1e-6) -> Column:
    return F.abs(c) < tol


def finite() -> Column:
    return F.count(F.when(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < 1e300) & (F.abs("y") < 1e300), 1))


# --- vector preparation

@query("distance", """SELECT a.vec_id AS item_id, round(list_distance(a.e, b.e), 6) + 0.0 AS euclidean,
  round(CASE WHEN list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e) > 0 THEN list_cosine_distance(a.e, b.e) ELSE 1 END, 6) + 0.0 AS cosine,
  round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: abs(a.e[i] - b.e[i]))), 6) + 0.0 AS manhattan,
  round(pow(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: pow(abs(a.e[i] - b.e[i]), 3))), 1.0 / 3), 6) + 0.0 AS minkowski
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def q_distance(spark, sf):
    a = vectors(spark, sf).select("item_id", F.col("embedding").alias("a"))
    b = vectors(spark, sf).select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("b"))
    pair = F.col("a"), F.col("b")
    return a.join(b, "item_id").select(
        "item_id", r6(distance(*pair)).alias("euclidean"), r6(distance(*pair, "cosine")).alias("cosine"),
        r6(distance(*pair, "manhattan")).alias("manhattan"), r6(distance(*pair, "minkowski", 3.0)).alias("minkowski"))


@query("moments", f"""WITH {CELLS} SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.v * b.v) / (count(*) - 1), 6) + 0.0 AS cov
  FROM cen a JOIN cen b USING (vec_id) GROUP BY 1, 2""")
def q_moments(spark, sf):
    return M.covariance_table(vectors(spark, sf)).select("i", "j", r6("cov").alias("cov"))


@query("moments_lineitem", """WITH cells AS (SELECT l_orderkey, l_linenumber, unnest([1, 2, 3, 4]) AS j,
  unnest([CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)]) AS v FROM lineitem)
  SELECT CAST(j AS INTEGER) AS j, count(*) AS n, round(avg(v), 8) + 0.0 AS mean, round(stddev_pop(v), 8) + 0.0 AS sd FROM cells GROUP BY j""")
def q_moments_lineitem(spark, sf):
    m = M.moments(lineitem_vectors(spark, sf))
    sd = (m.scatter.diagonal() / m.n) ** 0.5
    rows = [(j + 1, m.n, float(m.mean[j]), float(sd[j])) for j in range(m.dim)]
    return spark.createDataFrame(rows, "j int, n bigint, mean double, sd double").select("j", "n", r6("mean", 8).alias("mean"), r6("sd", 8).alias("sd"))


def lineitem_vectors(spark, sf) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.col("l_returnflag").alias("group_key"),
        F.array(*[F.col(c).cast("double") for c in cols]).alias("embedding"))


def _cells_of(df: DataFrame) -> DataFrame:
    return df.select("item_id", F.posexplode("embedding").alias("j", "v")).select("item_id", (F.col("j") + 1).alias("j"), r6("v").alias("v"))


@query("standardise", f"""WITH {CELLS}, sd AS (SELECT j, stddev_pop(v) AS s FROM cells GROUP BY j)
  SELECT vec_id AS item_id, CAST(j AS INTEGER) AS j, round(v / (CASE WHEN s > 0 THEN s ELSE 1 END), 6) + 0.0 AS v FROM cen JOIN sd USING (j)""")
def q_standardise(spark, sf):
    return _cells_of(M.standardise(vectors(spark, sf)))


@query("l2_normalise", """WITH e AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS e FROM embeddings)
  SELECT vec_id AS item_id, CAST(unnest(range(1, len(e) + 1)) AS INTEGER) AS j,
  unnest(list_transform(e, lambda x: round(x / sqrt(list_inner_product(e, e)), 6) + 0.0)) AS v FROM e""")
def q_l2(spark, sf):
    grown = vectors(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x * (F.col("group_key") + 1)))
    return _cells_of(M.normalise_rows(grown))


@query("minmax_shift", f"""WITH {CELLS}, low AS (SELECT least(min(v), 0) AS m FROM cells)
  SELECT vec_id AS item_id, CAST(j AS INTEGER) AS j, round(v - m, 6) + 0.0 AS v FROM cells, low""")
def q_shift(spark, sf):
    return _cells_of(M.minmax_shift(vectors(spark, sf)))


# --- moment-based projections

@query("preprocess_pca", f"""WITH RECURSIVE placed AS ({_pca_sql(12)})
  SELECT a.item_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) + 0.0 AS dist
  FROM placed a JOIN placed b ON b.item_id = a.item_id + 1""")
def q_preprocess(spark, sf):
    """Distances between consecutive items after the reduction."""
    short = preprocess_pca(vectors(spark, sf), 2)
    a = short.select("item_id", F.col("embedding").alias("a"))
    b = short.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("b"))
    return a.join(b, "item_id").select("item_id", r6(distance(F.col("a"), F.col("b"))).alias("dist"))


@query("pca", PCA_SQL)
def q_pca(spark, sf):
    return placed(run_method(vectors(spark, sf), "pca"))


@query("ipca", PCA_SQL)
def q_ipca(spark, sf):
    return placed(run_method(vectors(spark, sf), "ipca"))


@query("pca_tsqr", PCA_SQL)
def q_pca_tree(spark, sf):
    """The same axes from a tree of QR factorisations, with a basis of all dimensions."""
    v = vectors(spark, sf)
    _, mean = count_and_mean(v)
    _, axes = range_svd(v, 2, mean, oversample=62)
    return placed(L.place(v, L.LinearMap(mean, L.fix_signs(axes)).apply))


@query("svd", SVD_SQL)
def q_svd(spark, sf):
    return placed(run_method(vectors(spark, sf), "svd"))


def _draws_sql(k: int) -> str:
    return f"""
r AS (SELECT j, c, ('0x' || substr(md5('42:' || (j - 1) || ':' || c || ':a'), 1, 8))::BIGINT / 4294967296.0 AS a,
   ('0x' || substr(md5('42:' || (j - 1) || ':' || c || ':b'), 1, 8))::BIGINT / 4294967296.0 AS b,
   ('0x' || substr(md5('42:' || (j - 1) || ':' || c), 1, 8))::BIGINT / 4294967296.0 AS u
   FROM (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS j), (SELECT unnest(range({k})) AS c))"""


@query("grp", f"""WITH {CELLS}, {_draws_sql(2)}, p AS (SELECT vec_id, c, sum(v * sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b) / sqrt(2.0)) AS y FROM cells JOIN r USING (j) GROUP BY 1, 2)
  SELECT vec_id AS item_id, label AS group_key, round(max(y) FILTER (c = 0), 6) + 0.0 AS x, round(max(y) FILTER (c = 1), 6) + 0.0 AS y
  FROM p JOIN embeddings USING (vec_id) GROUP BY 1, 2""")
def q_grp(spark, sf):
    return placed(run_method(vectors(spark, sf), "grp"))


@query("srp", f"""WITH {CELLS}, {_draws_sql(2)}, d AS (SELECT 1 / sqrt(max(len(embedding))) AS s FROM embeddings),
  p AS (SELECT vec_id, c, sum(v * CASE WHEN u < s / 2 THEN sqrt(1 / (s * 2)) WHEN u >= 1 - s / 2 THEN -sqrt(1 / (s * 2)) ELSE 0 END) AS y FROM cells JOIN r USING (j), d GROUP BY 1, 2)
  SELECT vec_id AS item_id, label AS group_key, round(max(y) FILTER (c = 0), 6) + 0.0 AS x, round(max(y) FILTER (c = 1), 6) + 0.0 AS y
  FROM p JOIN embeddings USING (vec_id) GROUP BY 1, 2""")
def q_srp(spark, sf):
    return placed(run_method(vectors(spark, sf), "srp"))


COUNT = "SELECT count(*) AS n, count(*) AS finite"


@query("fa", f"{COUNT}, true AS centred, true AS rising, true AS noise_positive FROM embeddings")
def q_fa(spark, sf):
    v = vectors(spark, sf)
    model = L.fit_fa(v)
    rising = all(b >= a - 1e-6 * abs(a) for a, b in zip(model.likelihood, model.likelihood[1:], strict=False))
    return cert(L.place(v, model.apply), n=F.count(F.lit(1)), finite=finite(),
                centred=near_zero(F.avg("x")) & near_zero(F.avg("y")), rising=F.lit(rising),
                noise_positive=F.lit(bool((model.noise > 0).all())))


@query("ica", "SELECT count(*) AS n, count(*) AS finite, true AS related, true AS independent, true AS centred, 1.0::DOUBLE AS var_x, 1.0::DOUBLE AS var_y, true AS uncorrelated FROM embeddings")
def q_ica(spark, sf):
    """Whitened, and turned to where both components are least Gaussian: every turn of the pair loses contrast."""
    v = vectors(spark, sf)
    made = run_method(v, "ica")
    gauss = 0.3745672075  # mean of ln cosh of a standard normal value

    def contrast(degrees):
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        parts = [F.pow(F.avg(F.log(F.cosh(u))) - gauss, 2) for u in (F.col("x") * c - F.col("y") * s, F.col("x") * s + F.col("y") * c)]
        return parts[0] + parts[1]

    turned = made.agg(*[contrast(d).alias(f"t{d}") for d in (0, 10, 25, 45, 65, 80)]).first()
    return cert(made, n=F.count(F.lit(1)), finite=finite(), related=related(made, v), independent=F.lit(turned["t0"] >= max(turned[1:])),
                centred=near_zero(F.avg("x")) & near_zero(F.avg("y")), var_x=r6(F.var_pop("x")), var_y=r6(F.var_pop("y")),
                uncorrelated=near_zero(F.covar_pop("x", "y")))


def _falling(values: list[float]) -> bool:
    return len(values) > 1 and all(b <= a + 1e-9 * abs(a) for a, b in zip(values, values[1:], strict=False))


@query("nmf", f"{COUNT}, true AS nonnegative, true AS falling FROM embeddings")
def q_nmf(spark, sf):
    v = M.minmax_shift(vectors(spark, sf))
    model = L.fit_nmf(v)
    return cert(L.place(v, model.apply), n=F.count(F.lit(1)), finite=finite(),
                nonnegative=(F.min("x") >= 0) & (F.min("y") >= 0) & F.lit(bool((model.atoms >= 0).all())), falling=F.lit(_falling(model.objective)))


@query("dictlearn", f"{COUNT}, true AS unit_ball, true AS falling FROM embeddings")
def q_dictlearn(spark, sf):
    v = vectors(spark, sf)
    model = L.fit_dictionary(v, alpha=0.1, max_iter=20)
    norms = ((model.atoms ** 2).sum(axis=1) ** 0.5).max()
    return cert(L.place(v, model.apply), n=F.count(F.lit(1)), finite=finite(), unit_ball=F.lit(bool(norms <= 1 + 1e-9)),
                falling=F.lit(_falling(model.objective)))


@query("agg", """SELECT vec_id AS item_id, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings""")
def q_agg(spark, sf):
    v = vectors(spark, sf)
    cluster = L.fit_agg(v)
    sizes = [int((cluster == c).sum()) for c in (0, 1)]
    made = run_method(v, "agg")
    return made.select("item_id", r6(F.col("x") * sizes[0] + F.col("y") * sizes[1]).alias("total"))


@query("kpca", PCA_SQL)
def q_kpca(spark, sf):
    """A linear kernel with at least d independent landmarks is plain PCA up to the sign of an axis."""
    v = vectors(spark, sf)
    k = run_method(v, "kpca", kernel="linear", landmarks=1024)
    p = L.fit_pca(v)
    truth = L.place(v, p.apply).select("item_id", F.col("x").alias("px"), F.col("y").alias("py"))
    signs = k.join(truth, "item_id").agg(F.signum(F.sum(F.col("x") * F.col("px"))).alias("sx"), F.signum(F.sum(F.col("y") * F.col("py"))).alias("sy")).first()
    return placed(k.withColumn("x", F.col("x") * F.lit(signs.sx)).withColumn("y", F.col("y") * F.lit(signs.sy)))


@query("kpca_rbf", f"{COUNT}, true AS centred, true AS uncorrelated, true AS ordered, true AS related FROM embeddings")
def q_kpca_rbf(spark, sf):
    return _kernel_cert(vectors(spark, sf), "kpca")


@query("nystroem_pca", f"{COUNT}, true AS centred, true AS uncorrelated, true AS ordered, true AS related FROM embeddings")
def q_nystroem(spark, sf):
    return _kernel_cert(vectors(spark, sf), "nystroem_pca")


def _kernel_cert(v, name):
    made = run_method(v, name)
    return cert(made, related=related(made, v), n=F.count(F.lit(1)), finite=finite(), centred=near_zero(F.avg("x")) & near_zero(F.avg("y")),
                uncorrelated=near_zero(F.covar_samp("x", "y")), ordered=F.var_samp("x") >= F.var_samp("y"))
