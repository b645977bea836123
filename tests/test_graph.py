import numpy as np
import pytest
from conftest import in_order
from pyspark.sql import functions as F

from planisphere.methods import graph as G
from planisphere.methods import stress as S
from planisphere.methods.linear import place
from planisphere.operators.graph import (
    Links, Neighbours, barycentre_weights, components, connect, contract, eigenvectors, geodesics, neighbours, product,
)
from planisphere.operators.pairs import number_nodes
from planisphere.registry import run_method, typed_params


def edges_of(spark, pairs):
    rows = [(a, b, float(w)) for a, b, w in pairs] + [(b, a, float(w)) for a, b, w in pairs]
    return spark.createDataFrame(rows, "src bigint, dst bigint, w double")


def star(spark, n=3000):
    """Node 0 holds every edge: the hot case of all look-ups."""
    return edges_of(spark, [(0, i, 1 + i % 3) for i in range(1, n)]), n


@pytest.mark.parametrize("limit", [None, 0])
def test_line_geodesics(spark, limit):
    links = Links(edges_of(spark, [(i, i + 1, 1 + i) for i in range(5)]), 6, limit=limit)
    got = {(r.node, r.mark): r.dist for r in geodesics(links, [0, 3]).collect()}
    assert got[(5, 0)] == 15 and got[(0, 1)] == 6 and got[(5, 1)] == 9 and len(got) == 12


def shortest(pairs, sources):
    """Bellman-Ford on one machine."""
    out = {}
    for mark, s in enumerate(sources):
        dist, open_ = {s: 0.0}, True
        while open_:
            open_ = False
            for a, b, w in pairs:
                if a in dist and dist[a] + w < dist.get(b, np.inf):
                    dist[b], open_ = dist[a] + w, True
        out.update({(n, mark): d for n, d in dist.items()})
    return out


@pytest.mark.parametrize("limit", [None, 0])
def test_contracted_paths_equal_plain_ones(spark, limit):
    """One-way and parallel edges, a hub, chains, loops and a part that no source reaches."""
    rng = np.random.default_rng(4)
    chain = [(i, i + 1, 1 + i % 4) for i in range(60)] + [(i + 1, i, 2 + i % 3) for i in range(50)]
    hub = [(7, i, 3) for i in range(61, 81)] + [(i, 7, 1) for i in range(61, 81)]
    loose = [(int(a), int(b), 1 + int(w)) for a, b, w in zip(rng.integers(61, 100, 60), rng.integers(61, 100, 60), rng.integers(0, 9, 60))]
    pairs = [*chain, *hub, *loose, (3, 3, 1), (10, 11, 9), (200, 201, 1), (201, 200, 1)]
    edges = spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src bigint, dst bigint, w double")
    links = Links(edges, 300, limit=limit)
    got = geodesics(links, [0, 70, 45], plain=2, degree=4)
    assert {(r.node, r.mark): r.dist for r in got.collect()} == shortest(pairs, [0, 70, 45])
    core, levels = contract(edges, [0, 70, 45], 4)
    kept = {r.src for r in core.collect()} | {r.dst for r in core.collect()}
    gone = [r.node for level in levels for r in level.collect()]
    assert len(levels) > 2 and len(gone) == len(set(gone)) and not kept & set(gone) and not {0, 70, 45} & set(gone)


def test_long_path_takes_few_rounds(spark, monkeypatch):
    from planisphere.operators import graph

    made, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, replaces=None: made.append(df.columns) or plain(df, replaces))
    links = Links(edges_of(spark, [(i, i + 1, 1) for i in range(2000)]), 2001)
    got = geodesics(links, [0]).collect()
    assert len(got) == 2001 and all(r.dist == r.node for r in got)
    rounds = sum("changed" in c or c[:3] == ["node", "mark", "dist"] for c in made)
    levels = sum("inward" in c for c in made)
    assert levels < 20 and rounds + levels < 60


def test_hot_node_products_agree(spark):
    """The shuffle form with salts gives what the broadcast form gives."""
    e, n = star(spark)
    values = spark.range(n).selectExpr("id AS node", "cast(id AS double) AS v0", "1D AS v1")
    got = []
    for limit in (None, 0):
        links = Links(e, n, limit=limit)
        assert links.small == (limit is None)
        if limit == 0:
            assert links.hot["src"].count() == 1 and links.edges.select("_salt_src").distinct().count() > 1
        got.append(in_order(product(links, values, 2), "a0", "a1", key="node"))
    np.testing.assert_allclose(got[0], got[1])
    assert got[0][0, 1] == sum(1 + i % 3 for i in range(1, n))


@pytest.mark.parametrize("limit", [None, 0])
def test_components(spark, limit):
    pairs = [(i, i + 1, 1) for i in range(20)] + [(30, 31, 1), (31, 32, 1)]
    nodes = spark.createDataFrame([(i,) for i in [*range(21), 30, 31, 32, 40]], "node bigint")
    got = {r.node: r.comp for r in components(Links(edges_of(spark, pairs), 25, limit=limit), nodes).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[30] == got[31] == got[32] == 30 and got[40] == 40


def test_disconnected_pairs_are_joined_by_their_closest_link(table, spark):
    x = [[0, 0], [1, 0], [10, 0], [11, 0], [10, 50.0]]
    nodes = number_nodes(table(x))
    nb = Neighbours(nodes, 5, None)
    whole = connect(nb, edges_of(spark, [(0, 1, 1), (2, 3, 1)]))
    got = {(r.src, r.dst): r.w for r in whole.collect()}
    assert got[(1, 2)] == got[(2, 1)] == 9 and got[(2, 4)] == 50 and len(got) == 8


def test_ring_eigenvectors(spark):
    """The ring has pairs of equal eigenvalues cos(2 pi j / n)."""
    n = 12
    e = edges_of(spark, [(i, (i + 1) % n, 0.5) for i in range(n)])
    links = Links(e, n)
    nodes = spark.range(n).withColumnRenamed("id", "node")
    found = eigenvectors(nodes, lambda v, m: product(links, v, m), 2, -1.0, 1.0, True, nodes.withColumn("u", F.lit(1.0)), extra=1, steps=4, tol=1e-6)
    np.testing.assert_allclose(found.values, [np.cos(2 * np.pi / n)] * 2, atol=1e-6)
    assert found.converged(1e-6) and not found.converged(-1.0)
    v = in_order(found.vectors, "v0", "v1", key="node")
    np.testing.assert_allclose(v.T @ v, np.eye(2), atol=1e-8)


def test_local_linear_bottom(table):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 10))
    nb = neighbours(table(x), 6)
    rows = barycentre_weights(nb).collect()
    w = np.zeros((80, 80))
    for r in rows:
        w[r.src, r.dst] = r.w
    np.testing.assert_allclose(w.sum(1), 1, atol=1e-9)
    i = 17
    near = [r.dst for r in nb.knn.filter(F.col("src") == i).orderBy("rank").collect()]
    z = x[near] - x[i]
    c = z @ z.T
    c += 1e-3 * np.trace(c) * np.eye(6)
    want = np.linalg.solve(c, np.ones(6))
    np.testing.assert_allclose(w[i, near], want / want.sum(), atol=1e-9)
    m = (np.eye(80) - w).T @ (np.eye(80) - w)
    found = G.bottom_vectors(nb, barycentre_weights(nb), 2, 24, 1e-4, 42)
    exact = np.linalg.eigvalsh(m)
    np.testing.assert_allclose(found.values, exact[1:3], atol=1e-3 * exact[-1])


def test_isomap_unrolls_a_plane(table):
    x = np.array([[i, j, 0.0] for i in range(8) for j in range(4)])
    got = in_order(run_method(table(x), "isomap", n_neighbors=4, landmarks=32), "x", "y")
    assert abs(np.corrcoef(got[:, 0], x[:, 0])[0, 1]) > 0.99
    with pytest.raises(ValueError, match="not connected"):
        run_method(table([[0, 0], [1, 0], [90, 0], [91, 0.0]]), "isomap", n_neighbors=1, on_disconnected="raise")


def test_phate_rows_are_stochastic(table, blobs):
    nb = neighbours(table(*blobs), 15)
    p, op = G.phate_operator(nb, G.decay_kernel(nb, 5, 40.0), 20, 1)
    sums = in_order(p.groupBy("node").agg(F.sum("p").alias("s")), "s", key="node")
    np.testing.assert_allclose(sums, 1, atol=1e-9)
    np.testing.assert_allclose(op.sum(1), 1, atol=1e-9)
    assert G.entropy_knee(op) >= 1


def test_scaling_of_a_square(table):
    x = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.0]])
    y = in_order(run_method(table(x), "mds"), "x", "y")
    np.testing.assert_allclose(S.gaps(y, y), S.gaps(x, x), atol=1e-3)
    # One random start may end in a crossed square; three points have one solution.
    y = in_order(run_method(table(x[:3]), "sammon_random"), "x", "y")
    np.testing.assert_allclose(S.gaps(y, y), S.gaps(x[:3], x[:3]), atol=1e-3)


def test_stress_only_falls_and_the_check_can_fail(blobs):
    d = S.gaps(blobs[0], blobs[0])
    _, h = S.smacof(d, S.random_start(len(d), 2, 1), 50)
    assert all(b <= a + 1e-9 for a, b in zip(h, h[1:]))
    from planisphere.plans.linear_queries import _falling

    assert _falling(h) and not _falling(h[::-1])


def test_rows_beyond_the_landmarks(table, blobs):
    df = table(*blobs)
    run, _ = S.fit_mds(df, typed_params("mds", {"landmarks": 40, "n_init": 1}))
    y = in_order(place(df, run), "x", "y")
    centre = np.array([y[blobs[1] == c].mean(0) for c in range(3)])
    assert (np.argmin(S.gaps(y, centre), axis=1) == blobs[1]).all()


def test_cluster_scaling_keeps_all_rows(table, blobs):
    y = in_order(run_method(table(*blobs), "clmds", n_clusters=3, landmarks=30, candidates=20), "x", "y")
    assert y.shape == (120, 2) and np.isfinite(y).all()


def pooled(values, weights):
    """Pool adjacent violators, one at a time."""
    blocks = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [b[0] for b in blocks for _ in range(b[2])]


def test_rising_fit_equals_one_by_one():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 400):
        for values in (rng.normal(size=n), np.arange(n)[::-1].astype(float), rng.integers(0, 3, n).astype(float) + np.arange(n) / 50):
            w = rng.uniform(0.5, 2, n)
            np.testing.assert_allclose(S.isotonic(values, w), pooled(values, w))


def test_scaling_by_ranks(table, blobs):
    """A bent scale of distances does not change the map of ranks; rows beyond the landmarks follow the curve."""
    y = np.random.default_rng(5).normal(size=(40, 2))
    delta = S.gaps(y, y)
    start = S.random_start(40, 2, 7)
    bent, history, _ = S.rank_smacof(np.expm1(delta), y + 0.1 * start, 300, 1e-6)
    straight, _, _ = S.rank_smacof(delta, y + 0.1 * start, 300, 1e-6)
    np.testing.assert_allclose(bent, straight, atol=1e-6)
    assert history[-1] < 1e-3 and all(b <= a + 1e-9 for a, b in zip(history, history[1:]))
    assert np.corrcoef(S.gaps(bent, bent).ravel(), delta.ravel())[0, 1] > 0.99
    x, labels = blobs
    made = in_order(run_method(table(x), "mds", metric=False, landmarks=30, n_init=2), "x", "y")
    centres = np.array([made[labels == c].mean(0) for c in range(3)])
    assert np.isfinite(made).all() and (np.argmin(S.gaps(made, centres), axis=1) == labels).mean() > 0.95


def test_certificates_fail_for_shuffled_maps(table, blobs):
    """What queries call related is a map of the right rows; the same places for shuffled rows are not."""
    from planisphere.operators.knn import knn_exact
    from planisphere.operators.quality import distance_agreement
    from planisphere.plans.graph_queries import _low_energy

    x = np.random.default_rng(2).normal(size=(300, 12))
    rows = table(x).persist()
    near = knn_exact(rows, 5).select("src", "dst").persist()
    spark = rows.sparkSession

    def coords(order, y):
        return spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(order, y)], "item_id bigint, x double, y double")

    right = distance_agreement(coords(range(300), x[:, :2]), rows, near=near).first()
    wrong = distance_agreement(coords(np.random.default_rng(1).permutation(300), x[:, :2]), rows, near=near).first()
    assert right["agreement"] > 0.2 and right["closeness"] < 0.9
    assert abs(wrong["agreement"]) < 0.05 and wrong["closeness"] > 0.97
    assert distance_agreement(coords(range(300), np.zeros((300, 2))), rows).first()["agreement"] == 0
    made, weights = G.fit_lle(rows, typed_params("lle", {"max_iter": 10}))
    noise = made.withColumn("x", F.randn(1)).withColumn("y", F.randn(2))
    assert str(_low_energy(weights, made)) != str(_low_energy(weights, noise.persist()))


def test_wide_rows_come_in_small_batches(table, spark, monkeypatch):
    """Blocks of vectors and of neighbours' vectors reach a worker in batches of bounded bytes, and the results stay."""
    from planisphere.operators import graph as O

    asked, plain = [], O.arrow_rows

    def small(session, row_bytes, batch_bytes=64 * 1024 * 1024):
        asked.append((row_bytes, batch_bytes))
        return plain(session, row_bytes, 16 * row_bytes)

    n = 40
    nodes = spark.range(n).withColumnRenamed("id", "node")
    links = Links(edges_of(spark, [(i, (i + 1) % n, 0.5) for i in range(n)]), n)

    def values():
        return eigenvectors(nodes, lambda v, m: product(links, v, m), 2, -1.0, 1.0, True, nodes.withColumn("u", F.lit(1.0)), extra=1, steps=2, max_iter=2).values

    nb = neighbours(table(np.random.default_rng(3).normal(size=(60, 4))), 5)

    def weights():
        return {(r.src, r.dst): r.w for r in barycentre_weights(nb).collect()}

    whole = values(), weights()
    monkeypatch.setattr(O, "arrow_rows", small)
    assert np.allclose(values(), whole[0], atol=1e-9)
    assert weights() == pytest.approx(whole[1], abs=1e-9)
    # Three vectors of two steps and the start, and the known one, read twice; then five neighbours' vectors and the row's own.
    assert [a for a, _ in asked] == [8 * 10, 8 * 10, 8 * 4 * 6]
    assert all(b <= 8 * 2**20 for _, b in asked)


def test_kernel_lists_take_two_joins(table, monkeypatch):
    """Rows whose first list is cut ask once more, up to their reach, and the kernel is that of all pairs."""
    x = np.random.default_rng(15).normal(size=(300, 12))
    joins, plain = [], G.knn_exact
    monkeypatch.setattr(G, "knn_exact", lambda *a, **k: joins.append(k) or plain(*a, **k))
    got = {(r.src, r.dst): r.w for r in G.decay_kernel(G.kernel_neighbours(table(x), 3, 8.0), 3, 8.0).collect()}
    d = S.gaps(x, x)
    eps = np.sort(d, axis=1)[:, 3]
    w = 0.5 * np.exp(-((d / eps[:, None]) ** 8)) + 0.5 * np.exp(-((d / eps[None]) ** 8))
    np.fill_diagonal(w, 1.0)
    want = {(i, j): w[i, j] for i, j in zip(*np.nonzero(w >= 1e-4))}
    assert len(joins) == 1 and len(want) > 300 * 24
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-9)


def test_landmark_operator_is_the_product(table):
    """The operator equals the product of both transition matrices, made without a row per pair of clusters."""
    x = np.random.default_rng(16).normal(size=(90, 4))
    nb = neighbours(table(x), 12)
    kernel = G.decay_kernel(nb, 5, 10.0)
    p, op = G.phate_operator(nb, kernel, 9, 1)
    at = {}
    for r in p.collect():
        at[r.node, r.cluster] = r.p
    degree = np.zeros(90)
    for r in kernel.collect():
        degree[r.src] += r.w
    share = np.zeros((90, op.shape[0]))
    for (i, c), v in at.items():
        share[i, c] = v
    want = (share * degree[:, None]).T @ share
    np.testing.assert_allclose(op, want / want.sum(axis=1, keepdims=True), atol=1e-9)
