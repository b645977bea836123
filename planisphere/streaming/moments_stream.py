"""PCA of an unbounded stream of vectors: exact moments merged batch by batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from planisphere.methods.linear import LinearMap, fit_pca
from planisphere.operators.moments import Moments, moments

_STATE = "batch bigint, n bigint, mean array<double>, scatter array<double>"


class MomentStream:
    """State of the stream in ``folder``: one small table per micro-batch.

    A batch that is run again after a failure writes the same state from the same
    predecessor, so nothing is counted twice. Moments do not depend on the order of
    the rows, so the stream needs no watermark.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _states(self) -> dict[int, str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("batch-")
                and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return {int(n[6:]): f"{self.folder}/{n}" for n in done}

    def current(self, before: int | None = None) -> Moments | None:
        """Moments of all batches so far, or of those with an id below ``before``."""
        found = {b: p for b, p in self._states().items() if before is None or b < before}
        if not found:
            return None
        row = self.spark.read.schema(_STATE).parquet(found[max(found)]).first()
        mean = np.array(row["mean"])
        return Moments(row["n"], mean, np.array(row["scatter"]).reshape(len(mean), len(mean)))

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """The function for ``foreachBatch``."""
        before = self.current(batch_id)
        if batch.isEmpty():
            return
        m = moments(batch)
        m = m if before is None else before.merge(m)
        row = [(batch_id, m.n, m.mean.tolist(), m.scatter.reshape(-1).tolist())]
        self.spark.createDataFrame(row, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id}")

    def run(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        """Start the query over a streaming table with a vector column ``embedding``."""
        writer = stream.select("embedding").writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def model(self, k: int = 2) -> LinearMap:
        m = self.current()
        if m is None:
            raise ValueError("the stream has no rows yet")
        return fit_pca(None, k, stats=m)
