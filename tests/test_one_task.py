import numpy as np
import pytest
from conftest import in_order

from planisphere.methods import graph as G
from planisphere.methods import layout as Y
from planisphere.methods import parametric as P
from planisphere.methods import tsne as T
from planisphere.operators import graph as O
from planisphere.operators.one_task import xxhash64
from planisphere.plans import all_queries, graph_queries, layout_queries
from planisphere.registry import typed_params

RNG = np.random.default_rng(21)
WHOLE = [
    ("lle", graph_queries, G, "fit_lle"), ("glle", graph_queries, G, "fit_glle"),
    ("umap", layout_queries, Y, "fit_umap"),
    ("spacemap", layout_queries, Y, "fit_spacemap"),
    ("tsne", layout_queries, T, "fit_tsne"),
    ("trimap", layout_queries, Y, "fit_trimap"),
    ("paramrepulsor", layout_queries, P, "fit_repulsor"),
]


@pytest.mark.parametrize("name,plans,module,fit", WHOLE)
def test_queries_run_at_the_settings_of_the_method(monkeypatch, name, plans, module, fit):
    """No fewer rounds and no other start than the method has by itself."""
    asked = []

    def stop(df, params):
        asked.append(params)
        raise InterruptedError

    monkeypatch.setattr(module, fit, stop)
    monkeypatch.setattr(plans, "vectors", lambda spark, sf: None)
    with pytest.raises(InterruptedError):
        all_queries()[name](None, "")
    assert asked == [typed_params(name)]


def both_ways(monkeypatch, make):
    """A result made in one task and by a job per step."""
    one = make()
    monkeypatch.setattr(O, "TASK_BYTES", 0)
    return one, make()


def test_hash_is_that_of_sql(spark):
    a = RNG.integers(-(2**62), 2**62, 50)
    rows = spark.createDataFrame([(int(v), i) for i, v in enumerate(a)], "a bigint, i int")
    want = [r[0] for r in rows.selectExpr("xxhash64(42, i, a, 7L) AS h", "i").orderBy("i").collect()]
    i = np.arange(50, dtype=np.int32)
    assert xxhash64(np.array([42], np.int32), i, a, np.array([7])).tolist() == want


@pytest.mark.parametrize("name", ["lle", "spectral"])
def test_eigenvectors_in_one_task(table, monkeypatch, name):
    """The blocks of one cycle span all 80 dimensions, so both forms find the eigenvalues themselves."""
    nb = O.neighbours(table(RNG.normal(size=(80, 6))), 8)
    if name == "lle":
        weights = O.barycentre_weights(nb)
        one, other = both_ways(monkeypatch, lambda: G.bottom_vectors(nb, weights, 2, 10, 1e-4, 42))
    else:
        one, other = both_ways(monkeypatch, lambda: G.fit_spectral(nb, typed_params("spectral", {"max_iter": 10}))[0])
    np.testing.assert_allclose(one.values, other.values, atol=1e-6)
    assert one.converged(1e-4) and other.converged(1e-4)
    v, w = (in_order(e.vectors, "v0", "v1", key="node") for e in (one, other))
    v, w = (np.linalg.qr(a)[0] for a in (v, w))
    np.testing.assert_allclose(np.linalg.svd(v.T @ w)[1], 1, atol=1e-4)


@pytest.mark.parametrize("name,fit,given", [
    ("umap", Y.fit_umap, {"n_epochs": 4, "init": "pca"}),
    ("spacemap", Y.fit_spacemap, {"n_epochs": 3, "init": "random", "n_near_field": 5, "n_middle_field": 9}),
    ("trimap", Y.fit_trimap, {"n_iters": 4}),
    ("trimap", Y.fit_trimap, {"n_iters": 3, "opt_method": "sd"}),
    ("tsne", T.fit_tsne, {"n_iter": 2, "early_exaggeration_iter": 2, "perplexity": 8, "learning_rate": 20.0}),
])
def test_layout_in_one_task(table, blobs, monkeypatch, name, fit, given):
    """The same map as by a job per step, draws included."""
    params = typed_params(name, given)
    one, other = both_ways(monkeypatch, lambda: in_order(fit(table(*blobs), params)[-1], "x", "y", "t", key="node"))
    np.testing.assert_allclose(one, other, rtol=1e-6, atol=1e-6 * np.abs(other[:, :2]).max())


def test_network_in_one_task(table, blobs, monkeypatch):
    params = typed_params("paramrepulsor", {"n_epochs": 4, "hidden": 7})
    one, other = both_ways(monkeypatch, lambda: P.fit_repulsor(table(*blobs), params)[1])
    for a, b in zip(one, other):
        np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-8)
