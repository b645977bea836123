"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_SCALE:
a number of jittered copies of the vectors for two extra scaling runs (default 10).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from planisphere.operators.knn import knn_cells  # noqa: E402
from planisphere.operators.subset import fetch_subset  # noqa: E402
from planisphere.plans import all_queries  # noqa: E402
from planisphere.plans.base import vectors  # noqa: E402
from planisphere.registry import run_method  # noqa: E402
from planisphere.session import cut, local_session  # noqa: E402

HEADLINE = [
    "scan_embeddings", "first_n_per_group", "random_subset", "assign_ids", "canvas_normalise", "density_tiles", "mosaic_top", "hit_test",
    "moments_lineitem", "pca", "svd", "grp", "agg", "nystroem_pca", "knn_exact", "knn_cosine", "symmetrise", "pacmap_near_pairs", "mds",
    "phate_kernel", "umap", "pacmap",
]


def grown(spark, sf, copies):
    """Seeded jittered copies of the vectors."""
    v = vectors(spark, sf)
    many = v.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    key = F.col("item_id") * copies + F.col("c")
    jitter = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.lit(0.05) * (F.pmod(F.xxhash64("item_id", "c", i), F.lit(2001)) / 1000.0 - 1.0))
    return cut(many.select(key.alias("item_id"), "group_key", F.zip_with("embedding", jitter, lambda a, b: a + b).alias("embedding")))


BASELINE = {
    "umap": {"n_neighbors": 10, "min_dist": 0.1, "n_epochs": 50}, "tsne": {"perplexity": 25, "n_iter": 30, "early_exaggeration_iter": 20},
    "tsne_pso": {"perplexity": 30, "n_particles": 10, "n_iter": 3}, "isomap": {"n_neighbors": 5}, "lle": {"n_neighbors": 15},
    "mds": {}, "spectral": {"n_neighbors": 10}, "pca": {},
}


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, 8)
    spark.sparkContext.setLogLevel("ERROR")
    vectors(spark, sf).count()
    times, all_q = {}, all_queries()

    def timed(name, fn):
        start = time.time()
        fn().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    timed("warm_up", lambda: all_q["pca"](spark, sf))
    times.clear()
    for name in HEADLINE:
        timed(name, lambda name=name: all_q[name](spark, sf))
    copies = int(os.environ.get("BENCH_SCALE", "10"))
    if copies > 0:
        big = grown(spark, sf, copies)
        timed(f"pca_x{copies}", lambda: run_method(big, "pca"))
        timed(f"mds_x{copies}", lambda: run_method(big, "mds", n_init=1))
        timed(f"knn_cells_x{copies}", lambda: knn_cells(big, 10, cells=64, probes=4))
    headline = dict(times)
    times.clear()
    if os.environ.get("BENCH_BASELINE", "1") != "0":
        rows = cut(fetch_subset(vectors(spark, sf), "random", 250))
        for name, params in BASELINE.items():
            timed(name, lambda name=name, params=params: run_method(rows, name, **params))
    baseline, times = dict(times), headline
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "baseline_runs": baseline, "baseline_steps": {k: v for k, v in BASELINE.items() if set(v) & {"n_epochs", "n_iter"}},
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus) if cpus.isdigit() else cpus}))


main()
