import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from planisphere.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """item_id, group_key, embedding from a matrix."""

    def make(x, groups=None, parts=3):
        rows = [(i, int(groups[i]) if groups is not None else 0, [float(v) for v in r]) for i, r in enumerate(np.asarray(x))]
        return spark.createDataFrame(rows, "item_id bigint, group_key int, embedding array<double>").repartition(parts)

    return make


@pytest.fixture(scope="session")
def blobs():
    """Three Gaussian groups, 10 deviations apart."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 10)) * 10
    labels = np.repeat(np.arange(3), 40)
    return centres[labels] + rng.normal(size=(120, 10)), labels


def in_order(df, *cols, key="item_id"):
    rows = df.orderBy(key).collect()
    return np.array([[r[c] for c in cols] for r in rows], dtype=float)
