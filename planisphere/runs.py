"""From a configuration to stored points, and from stored points to a canvas."""

from __future__ import annotations

import contextvars
import math
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from planisphere.functions.canvas import SHRINK_ABOVE, canvas_positions, extent
from planisphere.operators.graph import share_neighbours
from planisphere.operators.subset import fetch_subset
from planisphere.registry import METHODS, RunConfig, method_names, run_method, schema_of, text_params, typed_params
from planisphere.session import cut, parallelism
from planisphere.sources.catalog import Catalog, Placed


def recorded(config: RunConfig) -> dict[str, str | None]:
    """The parameters a run record keeps: catalogue columns, and options only where given."""
    typed = typed_params(config.method, config.params)
    listed = {p.name for p in schema_of(config.method)}
    return text_params({k: v for k, v in typed.items() if k in listed or k in config.params})


def placed_once(wanted: dict[int, DataFrame], placed: dict[int, DataFrame]) -> dict[int, tuple[int, int]]:
    """Per run the rows placed, and the items that were not placed exactly as often as they were selected; one pass for all runs."""
    sides = [(df, run, sign) for frames, sign in ((wanted, -1), (placed, 1)) for run, df in frames.items()]
    tagged = [df.select(F.lit(run).alias("run"), "item_id", F.lit(sign).alias("sign")) for df, run, sign in sides]
    items = reduce(DataFrame.unionByName, tagged).groupBy("run", "item_id").agg(F.sum("sign").alias("gap"), F.count_if(F.col("sign") > 0).alias("n"))
    return {r["run"]: (r["n"], r["lost"]) for r in items.groupBy("run").agg(F.sum("n").alias("n"), F.count_if(F.col("gap") != 0).alias("lost")).collect()}


def place_run(rows: DataFrame, config: RunConfig) -> tuple[DataFrame, float]:
    """Coordinates of the rows of a run as a stored table, and the seconds it took."""
    start = time.time()
    coords = cut(run_method(rows, config.method, **config.params))
    return coords, time.time() - start


def check_plane(config: RunConfig) -> None:
    """A stored map has two components; clusters, dimensions and components beyond that are refused, never cut."""
    typed = typed_params(config.method, config.params)
    for name in ("n_components", "n_dims", "n_clusters" if config.method == "agg" else ""):
        if typed.get(name, 2) != 2:
            raise ValueError(f"a stored map has two components; {config.method} was asked for {name}={typed[name]}")


def seed_of(config: RunConfig) -> int:
    return int(config.params.get("random_state", 42))


def run_all(embeddings: DataFrame, configs: list[RunConfig], workers: int | None = None) -> list[tuple[DataFrame, DataFrame, float] | Exception]:
    """Rows, coordinates and seconds of every configuration, or the error it ended with.

    Rows are selected once per (strategy, size, seed) and methods on the same rows share one
    neighbour join per metric. Configurations run side by side, each in a scheduler pool and job
    group of its own, so that small jobs fill the gaps that large ones leave.
    """
    spark = embeddings.sparkSession
    keys = [(c.subset_strategy, c.subset_size, seed_of(c) if c.subset_strategy == "random" else None) for c in configs]
    batch = uuid.uuid4().hex[:8]

    def in_pool(name, fn, *args):
        """``fn`` in a thread that carries this one's context and local properties."""
        context = contextvars.copy_context()

        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            spark.sparkContext.setJobGroup(f"{batch}-{name}", name)
            return context.run(fn, *args)

        return threads.submit(inheritable_thread_target(spark)(run))

    def result(job):
        try:
            return job.result()
        except Exception as error:  # noqa: BLE001 - one configuration's failure is its own outcome
            return error

    with share_neighbours(), ThreadPoolExecutor(workers or min(parallelism(spark), 8)) as threads:
        distinct = list(dict.fromkeys(keys))
        chosen = [in_pool(f"rows-{i}", lambda k=k: cut(fetch_subset(embeddings, k[0], k[1], k[2] or 42))) for i, k in enumerate(distinct)]
        subsets = {k: job.result() for k, job in zip(distinct, chosen)}
        jobs = [in_pool(f"run-{i}", place_run, subsets[k], c) for i, (k, c) in enumerate(zip(keys, configs))]
        done = [result(job) for job in jobs]
    return [d if isinstance(d, Exception) else (subsets[k], *d) for k, d in zip(keys, done)]


def store_all(catalog: Catalog, configs: list[RunConfig], done: list, mode: str) -> list[int | Exception]:
    """Store what was placed completely, in one pass; config ids, or what went wrong, in the order of the configurations."""
    out = list(done)
    good = [i for i, d in enumerate(done) if not isinstance(d, Exception)]
    if not good:
        return out
    counts = placed_once({i: done[i][0] for i in good}, {i: done[i][1] for i in good})
    batch = []
    for i in good:
        n, lost = counts.get(i, (0, 0))
        if lost:
            out[i] = ValueError(f"{configs[i].method} lost or doubled rows: {lost} items of {n} placed rows")
        else:
            batch.append((i, Placed(configs[i].method, recorded(configs[i]), configs[i].subset_strategy, configs[i].subset_size, done[i][2], done[i][1], n)))
    listed = {c.method: [p.name for p in schema_of(c.method) if p.name != "random_state"] for c in configs}
    for (i, _), config_id in zip(batch, catalog.save_runs([p for _, p in batch], mode, listed)):
        out[i] = config_id
    return out


def run_reduction(catalog: Catalog, embeddings: DataFrame, config: RunConfig, mode: str = "strict", subset: DataFrame | None = None) -> int:
    """Select the rows of a configuration, place them, store points and run record; returns the config id.

    Every selected row must be placed exactly once, otherwise nothing is stored.
    """
    check_plane(config)
    rows = subset if subset is not None else cut(fetch_subset(embeddings, config.subset_strategy, config.subset_size, seed_of(config)))
    outcome = store_all(catalog, [config], [(rows, *place_run(rows, config))], mode)[0]
    if isinstance(outcome, Exception):
        raise outcome
    return outcome


def sweep(catalog: Catalog, embeddings: DataFrame, configs: Iterable[RunConfig], mode: str = "strict", workers: int | None = None) -> DataFrame:
    """Run many configurations side by side and store them in one pass.

    One row per configuration with its run id, or the reason it was left out; a configuration that
    fails does not stop the others.
    """
    configs = list(configs)
    out: dict[int, tuple[int | None, str]] = {}
    wanted = []
    for i, c in enumerate(configs):
        if c.method not in METHODS:
            out[i] = (None, "not supported")
            continue
        try:
            check_plane(c)
            wanted.append(i)
        except ValueError as error:
            out[i] = (None, f"failed: {error}")
    chosen = [configs[i] for i in wanted]
    for i, outcome in zip(wanted, store_all(catalog, chosen, run_all(embeddings, chosen, workers), mode)):
        failed = isinstance(outcome, Exception)
        out[i] = (None, f"failed: {outcome}") if failed else (outcome, "stored")
    rows = [(c.method, c.name, *out[i]) for i, c in enumerate(configs)]
    return embeddings.sparkSession.createDataFrame(rows, "method string, name string, config_id bigint, outcome string")


def caption(run: Row) -> str:
    """What a picture says about its run: the subset, the runtime and the parameters in catalogue order."""
    params = dict(run["params"] or {})
    order = [p.name for p in schema_of(run["method"])] if run["method"] in method_names() else []
    named = {k: params[k] for k in [*[n for n in order if n in params], *sorted(set(params) - set(order))]}
    stated = {"subset_strategy": run["subset_strategy"], "subset_size": run["subset_size"], "runtime": run["runtime"], **named}
    return f"{run['method'].upper()} (config {run['config_id']}): " + ", ".join(f"{k}={v}" for k, v in stated.items())


def visualise_all(catalog: Catalog, wanted: Iterable[tuple[str, int]]) -> list[tuple[str, int, int | None]]:
    """Normalise the runs of a list to the canvas and store them in one pass.

    (method, config id, viz id), where a run without points is skipped with no viz id. The caption states
    the parameters of the run; pictures shrink once there are more than the canvas shows in full.
    """
    spark, wanted = catalog.spark, [(m, int(c)) for m, c in wanted]
    if not wanted:
        return []
    listed = spark.createDataFrame(list(dict.fromkeys(wanted)), "method string, config_id bigint")
    partition = reduce(lambda a, b: a | b, [(F.col("method") == m) & (F.col("config_id") == c) for m, c in dict.fromkeys(wanted)])
    points = catalog.read("points").filter(partition)
    runs = catalog.read("runs").join(F.broadcast(listed), ["method", "config_id"])
    captions = {(r["method"], r["config_id"]): caption(r) for r in runs.collect()}
    ends = cut(extent(points, "method", "config_id").join(points.groupBy("method", "config_id").agg(F.count(F.lit(1)).alias("n")), ["method", "config_id"]))
    sizes = {(r["method"], r["config_id"]): r["n"] for r in ends.collect()}  # one row per run of the list
    found = [w for w in wanted if w in sizes]
    canvas = canvas_positions(points.join(F.broadcast(ends.drop("n")), ["method", "config_id"]))
    images = [(m, c, f"{m}_{c}.avif", captions.get((m, c), ""), math.sqrt(min(SHRINK_ABOVE / sizes[m, c], 1.0))) for m, c in dict.fromkeys(found)]
    ids = {(m, c): v for (m, c, *_), v in zip(images, catalog.save_vizs(canvas, images))}
    return [(m, c, ids.get((m, c))) for m, c in wanted]


def visualise(catalog: Catalog, method: str, config_id: int) -> int:
    """Normalise all points of a run to the canvas and store them as a visualisation."""
    viz_id = visualise_all(catalog, [(method, config_id)])[0][2]
    if viz_id is None:
        raise ValueError(f"run {config_id} of {method} has no points")
    return viz_id
