import numpy as np

from planisphere.operators.moments import moments
from planisphere.streaming.moments_stream import MomentStream


def test_stream_equals_batch(spark, table, tmp_path):
    x = np.random.default_rng(1).normal(size=(60, 4)) + 5
    df = table(x).select("embedding")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = MomentStream(spark, str(tmp_path / "state"))
    state.run(stream, str(tmp_path / "offsets")).awaitTermination()
    got, want = state.current(), moments(df)
    assert got.n == 60 and len(state._states()) == 4
    np.testing.assert_allclose(got.covariance(), want.covariance(), atol=1e-10)
    # Running the last batch again changes nothing; new files only add.
    last = max(state._states())
    part = spark.read.schema(df.schema).parquet(str(tmp_path / "in")).limit(0)
    state.update(part, last + 1)
    assert state.current().n == 60
    before = state.current(last)
    state.update(df.limit(60 - before.n), last)
    assert state.current().n == 60


def test_axes_from_the_stream(spark, table, tmp_path):
    x = np.random.default_rng(2).normal(size=(30, 3)) @ np.diag([4, 2, 1])
    state = MomentStream(spark, str(tmp_path / "s"))
    state.update(table(x[:10]), 0)
    state.update(table(x[10:]), 1)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    np.testing.assert_allclose(state.model(2).values, values[:2], rtol=1e-9)
