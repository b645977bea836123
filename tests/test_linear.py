import numpy as np
import pytest
from conftest import in_order

from planisphere.methods import linear as L
from planisphere.operators.moments import minmax_shift, moments, standardise
from planisphere.registry import run_method

X = np.random.default_rng(7).normal(size=(90, 6)) @ np.diag([5, 3, 2, 1, 1, 0.5]) + 4


def xy(df):
    return in_order(df, "x", "y")


def test_moments_do_not_depend_on_partitions(table):
    for parts in (1, 4, 17):
        m = moments(table(X, parts=parts))
        assert m.n == 90
        np.testing.assert_allclose(m.covariance(), np.cov(X.T), atol=1e-10)
        np.testing.assert_allclose(m.gram, X.T @ X, rtol=1e-10)


def test_many_matrix_blocks(table):
    x = np.random.default_rng(1).normal(size=(40, 200))
    np.testing.assert_allclose(moments(table(x, parts=6)).covariance(), np.cov(x.T), atol=1e-9)


def test_pca_and_its_relatives(table):
    c = X - X.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    want = np.abs(c @ vt[:2].T)
    df = table(X)
    np.testing.assert_allclose(np.abs(xy(run_method(df, "pca"))), want, atol=1e-8)
    np.testing.assert_allclose(xy(run_method(df, "ipca", batch_size=7)), xy(run_method(df, "pca")), atol=1e-9)
    np.testing.assert_allclose(xy(L.place(df, L.fit_pca(df, 2, solver="tsqr").apply)), xy(run_method(df, "pca")), atol=1e-5)
    np.testing.assert_allclose(np.abs(xy(run_method(df, "kpca", kernel="linear"))), want, atol=1e-6)
    u, s, vt = np.linalg.svd(X, full_matrices=False)
    np.testing.assert_allclose(np.abs(xy(run_method(df, "svd"))), np.abs(X @ vt[:2].T), atol=1e-8)


def test_unit_square(table):
    got = xy(run_method(table([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.0]]), "pca"))
    d = np.sqrt(((got[:, None] - got[None]) ** 2).sum(2))
    np.testing.assert_allclose(sorted(d[0]), [0, 1, 1, np.sqrt(2)], atol=1e-9)


def test_exact_kernel_map(table):
    x = X[:40]
    k = np.exp(-0.05 * ((x[:, None] - x[None]) ** 2).sum(2))
    j = np.eye(40) - 1 / 40
    values, vectors = np.linalg.eigh(j @ k @ j)
    want = np.abs(vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2]))
    got = np.abs(xy(run_method(table(x), "kpca", gamma=0.05)))
    np.testing.assert_allclose(got, want, atol=1e-5)


def test_random_projections_match_their_matrices(table):
    df = table(X)
    np.testing.assert_allclose(xy(run_method(df, "grp")), X @ L.gaussian_matrix(42, 6, 2), atol=1e-10)
    np.testing.assert_allclose(xy(run_method(df, "srp")), X @ L.sparse_matrix(42, 6, 2), atol=1e-10)
    r = L.sparse_matrix(1, 4000, 2)
    assert abs((r != 0).mean() - 1 / np.sqrt(4000)) < 0.01


def test_factor_analysis(table):
    model = L.fit_fa(table(X))
    assert all(b >= a - 1e-6 for a, b in zip(model.likelihood, model.likelihood[1:]))
    got = xy(L.place(table(X), model.apply))
    np.testing.assert_allclose(got.mean(0), 0, atol=1e-9)


def test_ica_separates_sources(table):
    rng = np.random.default_rng(5)
    s = np.stack([rng.uniform(-1, 1, 400), np.sign(rng.normal(size=400)) + 0.05 * rng.normal(size=400)], axis=1)
    got = xy(run_method(table(s @ np.array([[1, 0.5], [0.3, 1]])), "ica"))
    c = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert c.max(axis=1).min() > 0.97


def test_nonnegative_factors(table):
    rng = np.random.default_rng(6)
    v = rng.uniform(size=(60, 2)) @ rng.uniform(size=(2, 5))
    model = L.fit_nmf(table(v), max_iter=100, tol=1e-10)
    got = xy(L.place(table(v), model.apply))
    assert (got >= 0).all() and (model.atoms >= 0).all()
    assert np.abs(got @ model.atoms - v).max() < 0.05
    assert all(b <= a + 1e-9 for a, b in zip(model.objective, model.objective[1:]))


def test_dictionary(table):
    model = L.fit_dictionary(table(X / 10), alpha=0.05, max_iter=15)
    assert all(b <= a + 1e-9 for a, b in zip(model.objective, model.objective[1:]))
    assert np.linalg.norm(model.atoms, axis=1).max() <= 1 + 1e-9
    # With a penalty above every correlation all codes are zero.
    assert not xy(L.place(table(X / 1000), lambda x: L.lasso_code(1.0)(x, model.atoms))).any()


def test_agglomerated_columns(table):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(50, 1)), 20 + rng.normal(size=(50, 1))
    x = np.hstack([a, b, a + 0.01, b + 0.01, a - 0.01])
    assert L.fit_agg(table(x)).tolist() == [0, 1, 0, 1, 0]


def test_scaling(table):
    x = X.copy()
    x[:, 2] = 3.0
    got = np.array([r.embedding for r in standardise(table(x)).orderBy("item_id").collect()])
    sd = x.std(0)
    np.testing.assert_allclose(got, (x - x.mean(0)) / np.where(sd > 0, sd, 1), atol=1e-9)
    low = np.array([r.embedding for r in minmax_shift(table(x - 9)).orderBy("item_id").collect()])
    assert abs(low.min()) < 1e-12


def test_guards(table, spark):
    with pytest.raises(ValueError):
        moments(spark.createDataFrame([], "embedding array<double>"))
    with pytest.raises(Exception, match="differ in length"):
        moments(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>").coalesce(1))
    with pytest.raises(NotImplementedError):
        run_method(table(X), "tsimcne")
    with pytest.raises(ValueError):
        run_method(table(X), "pca", colour="red")


def decaying(n, d, seed=3):
    rng = np.random.default_rng(seed)
    left, right = np.linalg.qr(rng.normal(size=(n, 20)))[0], np.linalg.qr(rng.normal(size=(d, 20)))[0]
    return (left * (50 * 0.7 ** np.arange(20))) @ right.T + rng.normal(size=(n, d)) * 1e-3 + rng.normal(size=d)


@pytest.mark.parametrize("name", ["pca", "svd", "fa", "ica"])
def test_narrow_solver_equals_exact(table, name):
    """The tree of factorisations finds at 512 dimensions what the full moments give."""
    df = table(decaying(300, 512)).persist()
    maps = [in_order(run_method(df, name, solver=s), "x", "y") for s in ("exact", "tsqr")]
    signs = np.sign((maps[0] * maps[1]).sum(0))
    np.testing.assert_allclose(maps[1] * signs, maps[0], atol=1e-5 * np.abs(maps[0]).max())
    with pytest.raises(ValueError, match="unknown solver"):
        run_method(df, name, solver="fast")


def test_wide_vectors(table):
    """8192 dimensions, where a square matrix of the dimension is never made; fewer rows than basis vectors."""
    x = decaying(60, 8192)
    df = table(x).persist()
    model = L.fit_pca(df, 2)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    np.testing.assert_allclose(model.values, s[:2] ** 2 / 59, rtol=1e-8)
    few = L.fit_svd(table(x[:5]), 2, solver="tsqr")
    np.testing.assert_allclose(few.values, np.linalg.svd(x[:5], compute_uv=False)[:2], rtol=1e-8)


def test_triangle_of_a_tree():
    from planisphere.operators.tall import qr_and_sum, triangle

    x = np.random.default_rng(0).normal(size=(40, 6))
    parts = [[triangle(p), p.T @ p] for p in (x[:3], x[3:20], x[20:])]
    r, total = qr_and_sum(qr_and_sum(parts[0], parts[1]), parts[2])
    np.testing.assert_allclose(r.T @ r, x.T @ x)
    np.testing.assert_allclose(total, x.T @ x)
