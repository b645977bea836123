"""The run catalogue: runs, projection points and visualisations as Parquet tables.

Points and canvas points are partitioned so that a lookup reads one partition.
Small tables that change in place (runs, visualisations) are written as a new
version folder; a version counts once its _SUCCESS marker exists, so a crash
leaves the previous one in force. There is no transaction over several tables:
rows that others refer to are written first.
"""

from __future__ import annotations

import time
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planisphere.operators.subset import assign_ids

SCHEMAS = {
    "runs": "method string, config_id bigint, subset_strategy string, subset_size int, runtime double, "
            "params map<string,string>",
    "points": "point_id bigint, item_id string, group_key string, x double, y double, method string, config_id bigint",
    "viz": "viz_id bigint, method string, config_id bigint, low_res string, caption string, scale double, created_at timestamp",
    "viz_points": "point_id bigint, viz_x int, viz_y int, viz_id bigint",
    "viz_ids": "chunk int, point_ids array<bigint>, viz_id bigint",
    "ids": "name string, last bigint",
}
PARTITIONS = {"points": ["method", "config_id"], "viz_points": ["viz_id"], "viz_ids": ["viz_id"]}


def identity(params, strategy, size, skip=("random_state",), listed: list[str] | Column | None = None, null_safe: bool = True):
    """Text that is equal for two runs of the same configuration.

    ``listed`` restricts the compared parameters; without ``null_safe`` an unset
    parameter makes the identity null, which matches nothing.
    """
    entries = F.filter(F.map_entries(params), lambda e: ~e["key"].isin(*skip))
    if isinstance(listed, Column):
        entries = F.filter(entries, lambda e: F.array_contains(listed, e["key"]))
    elif listed is not None:
        entries = F.filter(entries, lambda e: e["key"].isin(*listed) if listed else F.lit(False))
    parts = F.transform(
        F.sort_array(entries), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<unset>")))
    )
    whole = F.concat_ws("|", strategy, size.cast("string"), F.array_join(parts, "|"))
    if null_safe:
        return whole
    return F.when(~F.exists(entries, lambda e: e["value"].isNull()), whole)


def _listed(listed, method):
    """The compared parameters as an array, which ``listed`` may hold per method."""
    if not isinstance(listed, dict):
        return listed
    arrays = [x for name, names in listed.items() for x in (F.lit(name), F.array(*[F.lit(n) for n in names]).cast("array<string>"))]
    return F.coalesce(F.create_map(*arrays)[method], F.array().cast("array<string>"))


def match_runs(runs: DataFrame, incoming: DataFrame, mode: str = "strict", listed=None, few: bool = False) -> DataFrame:
    """Incoming rows with the ``config_id`` each gets: the id of the run of the same identity, or the next free one.

    ``hit``: the run was there before. ``last``: of the rows of a batch with one identity, the one that
    counts; it is the last in arrival order.
    """
    if mode not in ("strict", "reference"):
        raise ValueError("mode is 'strict' or 'reference'")
    safe = mode == "strict"
    key = identity(F.col("params"), F.col("subset_strategy"), F.col("subset_size"), listed=None if safe else _listed(listed, F.col("method")), null_safe=safe)
    # A row whose identity is null matches nothing, itself included.
    new = incoming.drop("config_id").withColumn("_key", key).withColumn("_unit", F.coalesce(F.concat(F.lit("="), "_key"), F.col("arrival").cast("string")))
    units = new.groupBy("method", "_unit").agg(F.max("arrival").alias("_last"))
    old = runs.withColumn("_key", key).filter(F.col("_key").isNotNull())
    hits = old.groupBy("method", F.concat(F.lit("="), "_key").alias("_unit")).agg(F.min("config_id").alias("_old"))
    found = units.join(hits, ["method", "_unit"], "left")
    missed = found.filter(F.col("_old").isNull()).join(runs.groupBy("method").agg(F.max("config_id").alias("_top")), "method", "left")
    rank = F.row_number().over(Window.partitionBy("method").orderBy("_last"))
    fresh = (missed.withColumn("_rank", rank) if few else number_within(missed, "method", "_last")).select(
        "method", "_unit", (F.coalesce("_top", F.lit(0)) + F.col("_rank")).cast("bigint").alias("config_id"), "_last", F.lit(False).alias("hit"))
    known = found.filter(F.col("_old").isNotNull()).select("method", "_unit", F.col("_old").alias("config_id"), "_last", F.lit(True).alias("hit"))
    joined = new.join(known.unionByName(fresh), ["method", "_unit"])
    return joined.withColumn("last", F.col("arrival") == F.col("_last")).drop("_key", "_unit", "_last")


def apply_runs(runs: DataFrame, matched: DataFrame) -> DataFrame:
    """The runs table after matched rows took over runtime and seed of their run, or became one."""
    counted = matched.filter("last")
    seed = F.create_map(F.lit("random_state"), F.col("new_params")["random_state"])
    update = counted.filter("hit").select("method", "config_id", F.col("runtime").alias("new_runtime"), F.col("params").alias("new_params"))
    kept = F.map_filter(F.col("params"), lambda k, v: k != "random_state")
    updated = runs.join(update, ["method", "config_id"], "left").select(
        "method", "config_id", "subset_strategy", "subset_size",
        F.coalesce("new_runtime", "runtime").alias("runtime"),
        F.when(F.col("new_params").isNotNull() & F.map_contains_key("params", "random_state"), F.map_concat(kept, seed))
        .otherwise(F.col("params")).alias("params"),
    )
    return updated.unionByName(counted.filter("not hit").select(*updated.columns))


def upsert_runs(runs: DataFrame, incoming: DataFrame, mode: str = "strict", listed=None, few: bool = False) -> DataFrame:
    """The runs table after incoming rows are matched by identity.

    A match takes over runtime and seed and keeps its id; a miss gets the next id.
    ``mode='strict'`` compares every parameter but the seed, null equal to null;
    ``mode='reference'`` compares the listed ones (a list, or one per method) and null matches
    nothing. ``few``: the incoming rows of one method fit a task, so they are numbered by a window.
    """
    return apply_runs(runs, match_runs(runs, incoming, mode, listed, few))


def number_within(df: DataFrame, group: str, order: str) -> DataFrame:
    """1, 2, 3 ... per group in order, without one task seeing a whole group.

    The global dense order of (group, order) minus the smallest of the group.
    """
    dense = assign_ids(df, [group, order], "_dense")
    start = dense.groupBy(group).agg(F.min("_dense").alias("_start"))
    return dense.join(start, group).withColumn("_rank", F.col("_dense") - F.col("_start") + 1).drop("_dense", "_start")


def identity_collisions(configs: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """Configurations of one method that would share, and so overwrite, one run."""
    key = identity(F.col("params"), F.col("subset_strategy"), F.col("subset_size"), listed=listed)
    return (
        configs.withColumn("identity", key).groupBy("method", "identity")
        .agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))
        .filter(F.col("n") > 1)
    )


def numbered_points(coords: DataFrame, top: int) -> DataFrame:
    """Rows for the points table with dense ids above ``top``, in order of arrival and item."""
    order = [*(["arrival"] if "arrival" in coords.columns else []), "item_id"]
    numbered = assign_ids(coords, order, "point_id", offset=top + 1)
    return numbered.select(
        "point_id", F.col("item_id").cast("string").alias("item_id"), F.col("group_key").cast("string").alias("group_key"),
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *order[:-1],
    )


def new_points(coords: DataFrame, method: str, config_id: int, top: int = 0) -> DataFrame:
    """The points of one run with dense ids above ``top``."""
    return numbered_points(coords, top).select("*", F.lit(method).alias("method"), F.lit(config_id).cast("bigint").alias("config_id"))


def with_image(viz: DataFrame, viz_id: int, low_res: str) -> DataFrame:
    """The visualisations with one picture path exchanged."""
    return viz.withColumn("low_res", F.when(F.col("viz_id") == viz_id, F.lit(low_res)).otherwise(F.col("low_res")))


@dataclass
class Placed:
    """A finished run on its way into the catalogue; ``rows``: how many rows it placed."""

    method: str
    params: dict
    strategy: str
    size: int
    runtime: float
    coords: DataFrame
    rows: int


def id_lists(viz_points: DataFrame, chunk: int = 65536) -> DataFrame:
    """The ordered point ids of every visualisation as arrays of bounded length: viz_id, chunk, point_ids."""
    placed = assign_ids(viz_points.select("viz_id", "point_id"), ["viz_id", "point_id"], "_no")
    first = placed.groupBy("viz_id").agg(F.min("_no").alias("_first"))
    part = F.floor((F.col("_no") - F.col("_first")) / chunk).cast("int")
    # One row per visualisation of the batch.
    lists = placed.join(F.broadcast(first), "viz_id").groupBy("viz_id", part.alias("chunk")).agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"))
    return lists.select("chunk", "point_ids", "viz_id")


class Catalog:
    """Parquet tables below one root folder.

    Writers take turns: a file that only one of them can create is held while ids are given
    out and versions are written, so two writers never get one id or one version. A
    writer that died leaves the file behind; after ``lease`` seconds it counts for nothing.
    """

    def __init__(self, spark: SparkSession, root: str, wait: float = 600.0, lease: float = 3600.0):
        self.spark, self.root, self.wait, self.lease = spark, root.rstrip("/"), wait, lease

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _claim(self, fs, p) -> bool:
        fs.mkdirs(p.getParent())
        if fs.getScheme() == "file":  # the local file system of Hadoop looks first and creates later
            return self.spark._jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).createNewFile()
        try:
            fs.create(p, False).close()
            return True
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise

    @contextmanager
    def writing(self):
        """The turn of one writer."""
        fs, p = self._fs(f"{self.root}/_writer")
        since = time.monotonic()
        while not self._claim(fs, p):
            with suppress(Py4JJavaError):  # the other one may finish meanwhile
                if time.time() * 1000 - fs.getFileStatus(p).getModificationTime() > self.lease * 1000:
                    fs.delete(p, False)
                    continue
            if time.monotonic() - since > self.wait:
                raise TimeoutError(f"another writer holds {p} for over {self.wait} s")
            time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(p, False)

    def _version(self, name: str) -> int:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return 0
        found = [s.getPath() for s in fs.listStatus(p)]
        versions = sorted((int(q.getName()[1:]) for q in found if q.getName().startswith("v")), reverse=True)
        return next((v for v in versions if self._exists(f"{self.root}/{name}/v{v}/_SUCCESS")), 0)

    def read(self, name: str) -> DataFrame:
        schema = SCHEMAS[name]
        if name in PARTITIONS:
            path = f"{self.root}/{name}"
            if not self._exists(path):
                return self.spark.createDataFrame([], schema)
            return self.spark.read.schema(schema).parquet(path)
        version = self._version(name)
        if version == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{version}")

    def write_version(self, name: str, df: DataFrame, keep: int = 16) -> None:
        """A new version; of the earlier ones the last ``keep`` stay for readers that hold them."""
        version = self._version(name) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}")
        fs, p = self._fs(f"{self.root}/{name}/v{version - keep}")
        if version > keep:
            fs.delete(p, True)

    def write_partitions(self, name: str, df: DataFrame) -> None:
        """Exchange only the partitions present in ``df``."""
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(*PARTITIONS[name]).parquet(f"{self.root}/{name}"))

    def drop_partition(self, name: str, **values) -> None:
        spec = "/".join(f"{k}={values[k]}" for k in PARTITIONS[name])
        fs, p = self._fs(f"{self.root}/{name}/{spec}")
        fs.delete(p, True)

    def _known_ids(self) -> dict[str, int]:
        return {r["name"]: r["last"] for r in self.read("ids").collect()} if self._version("ids") else {}  # one row per kind of id

    def last_id(self, name: str, column: str) -> int:
        """The largest id ever given out; a catalogue that has no record of it yet is searched."""
        known = self._known_ids()
        if name in known or not self._exists(f"{self.root}/{name}"):
            return known.get(name, 0)
        return self.read(name).agg(F.coalesce(F.max(column), F.lit(0)).alias("m")).first()["m"]

    def _record_ids(self, **last: int) -> None:
        rows = list((self._known_ids() | last).items())
        self.write_version("ids", self.spark.createDataFrame(rows, SCHEMAS["ids"]).coalesce(1))

    def save_runs(self, batch: list[Placed], mode: str = "strict", listed: dict[str, list[str]] | None = None) -> list[int]:
        """Store the points of finished runs, then publish their records, all in one pass; returns the config ids.

        Of runs with one identity the last counts, as if they came one after the other.
        """
        if not batch:
            return []
        rows = [(r.method, 0, r.strategy, r.size, r.runtime, r.params, i) for i, r in enumerate(batch)]
        incoming = self.spark.createDataFrame(rows, SCHEMAS["runs"] + ", arrival int").coalesce(1)
        with self.writing():
            runs = self.read("runs")
            matched = match_runs(runs, incoming, mode, listed, few=True)
            found = {r["arrival"]: r for r in matched.collect()}  # one row per run of the batch
            matched = self.spark.createDataFrame(list(found.values()), matched.schema).coalesce(1)
            kept = [i for i in sorted(found) if found[i]["last"] and batch[i].rows]
            if kept:
                top = self.last_id("points", "point_id")
                self._record_ids(points=top + sum(batch[i].rows for i in kept))
                coords = [batch[i].coords.select(F.lit(i).alias("arrival"), "item_id", "group_key", "x", "y") for i in kept]
                method, config = F.array(*[F.lit(r.method) for r in batch]), F.array(*[F.lit(found[i]["config_id"]) for i in range(len(batch))])
                points = numbered_points(reduce(DataFrame.unionByName, coords), top)
                self.write_partitions("points", points.select(
                    "*", F.element_at(method, F.col("arrival") + 1).alias("method"), F.element_at(config, F.col("arrival") + 1).alias("config_id")).drop("arrival"))
            for i, r in found.items():
                if r["last"] and not batch[i].rows:
                    self.drop_partition("points", method=r["method"], config_id=r["config_id"])
            self.write_version("runs", apply_runs(runs, matched))
        return [found[i]["config_id"] for i in range(len(batch))]

    def save_points(self, coords: DataFrame, method: str, config_id: int, above: int = 0) -> None:
        """Store the points of one run in place of earlier ones, with ids beyond all that were given out and ``above``."""
        with self.writing():
            top = max(self.last_id("points", "point_id"), above)
            fresh = new_points(coords, method, config_id, top)
            n = fresh.count()
            if n == 0:
                self.drop_partition("points", method=method, config_id=config_id)
                return
            self._record_ids(points=top + n)
            self.write_partitions("points", fresh)

    def replace_points(self, fresh: DataFrame, method: str, config_id: int) -> None:
        """Exchange the points of one run for ``fresh``, rows of the points table; no row empties the run."""
        mine = fresh.filter((F.col("method") == method) & (F.col("config_id") == config_id))
        with self.writing():
            last = mine.agg(F.max("point_id").alias("m")).first()["m"]
            if last is None:
                self.drop_partition("points", method=method, config_id=config_id)
                return
            self._record_ids(points=max(last, self.last_id("points", "point_id")))
            self.write_partitions("points", mine)

    def save_vizs(self, canvas: DataFrame, images: list[tuple[str, int, str, str, float]]) -> list[int]:
        """Store visualisations of several runs in one pass; returns their ids.

        ``canvas`` holds method, config_id, point_id, viz_x and viz_y; ``images`` method, config id, picture
        path, caption and scale. Canvas points and id lists are written before the rows that make them visible.
        """
        if not images:
            return []
        with self.writing():
            first = self.last_id("viz", "viz_id") + 1
            ids = [first + i for i in range(len(images))]
            self._record_ids(viz=ids[-1])
            rows = [(v, m, c, path, caption, float(scale)) for v, (m, c, path, caption, scale) in zip(ids, images)]
            viz = self.spark.createDataFrame(rows, "viz_id bigint, method string, config_id bigint, low_res string, caption string, scale double").coalesce(1)
            points = canvas.join(F.broadcast(viz.select("viz_id", "method", "config_id")), ["method", "config_id"])
            self.write_partitions("viz_points", points.select("point_id", "viz_x", "viz_y", "viz_id"))
            written = self.read("viz_points").filter(F.col("viz_id").between(ids[0], ids[-1]))
            self.write_partitions("viz_ids", id_lists(written))
            self.write_version("viz", self.read("viz").unionByName(viz.withColumn("created_at", F.current_timestamp())))
        return ids

    def save_viz(self, method: str, config_id: int, low_res: str, canvas: DataFrame, caption: str = "", scale: float = 1.0) -> int:
        placed = canvas.withColumns({"method": F.lit(method), "config_id": F.lit(config_id).cast("bigint")})
        return self.save_vizs(placed, [(method, config_id, low_res, caption, scale)])[0]

    def update_viz_image(self, viz_id: int, low_res: str) -> None:
        with self.writing():
            self.write_version("viz", with_image(self.read("viz"), viz_id, low_res))
