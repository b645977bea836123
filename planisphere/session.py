"""Session helpers: lineage cuts, checked broadcasts and parallelism."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(app: str = "planisphere", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def package_file(folder: str) -> str:
    """The package as a zip file for ``spark.sparkContext.addPyFile``, so that workers of a cluster can import it."""
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "planisphere.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(here)))
    return path


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for local masters."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if configured:
        if current.isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if not current.isEmpty():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="planisphere-")
    sc.setCheckpointDir(folder)
    return folder


_FOLDERS: list[str] = []


def _written(spark: SparkSession, folder: str) -> None:
    """Remember a folder of :func:`cut`; what is left of them goes when the driver ends, as nothing can read it then."""
    if not _FOLDERS:
        atexit.register(_forget, spark)
    _FOLDERS.append(folder)


def _forget(spark: SparkSession) -> None:
    with suppress(Exception):  # the JVM may be gone
        conf = spark._jsc.hadoopConfiguration()
        for folder in _FOLDERS:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back.

    Survives the loss of executors, ends the lineage, and gives the optimiser the
    true size of the result; a loop that joins its own state would otherwise carry
    ever larger size estimates from step to step. ``replaces`` is an earlier result
    of this function that nothing refers to any more; its files are deleted.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._cut_folder = folder
    _written(spark, folder)
    old = getattr(replaces, "_cut_folder", None)
    if old:
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        with suppress(ValueError):
            _FOLDERS.remove(old)
    return out


_BATCHES: dict[str, object] = {"lock": threading.Lock(), "wanted": [], "before": None}


@contextmanager
def arrow_rows(spark: SparkSession, row_bytes: int, batch_bytes: int = 64 * 1024 * 1024):
    """Arrow batches of about ``batch_bytes`` for jobs started inside the block.

    Blocks of several threads share the session's setting; the smallest one holds while any is open.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    mine = max(batch_bytes // max(row_bytes, 1), 16)
    state = _BATCHES
    with state["lock"]:
        if not state["wanted"]:
            state["before"] = spark.conf.get(name)
        state["wanted"].append(mine)
        spark.conf.set(name, str(min(int(state["before"]), *state["wanted"])))
    try:
        yield
    finally:
        with state["lock"]:
            state["wanted"].remove(mine)
            spark.conf.set(name, str(min([int(state["before"]), *state["wanted"]])))


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.sparkContext.defaultParallelism), 1)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only where ``rows * row_bytes`` is known to be small.

    Beyond the limit the join stays a shuffle join chosen by the optimiser.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core for rows that are costly to compute; larger inputs stay as they are."""
    cores = parallelism(df.sparkSession)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
