import numpy as np
import pytest
from conftest import in_order
from pyspark.sql import functions as F

from planisphere.methods import layout as Y
from planisphere.methods import parametric as P
from planisphere.methods import tsne as T
from planisphere.operators import quadtree
from planisphere.operators.graph import Links, neighbours
from planisphere.operators.layout import adam, gather, messages, moved, near_pairs, repulsion_grid, step, update
from planisphere.registry import run_method, typed_params

RNG = np.random.default_rng(11)


def state_of(spark, y, **more):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(y)]
    df = spark.createDataFrame(rows, "node bigint, x double, y double")
    return df.select("*", *[F.lit(float(v)).alias(k) for k, v in more.items()])


def numeric(loss, y, h=1e-5):
    g = np.zeros_like(y)
    for i in np.ndindex(*y.shape):
        up, down = y.copy(), y.copy()
        up[i] += h
        down[i] -= h
        g[i] = (loss(up) - loss(down)) / (2 * h)
    return g


@pytest.mark.parametrize("limit", [None, 0])
def test_pacmap_gradient(spark, limit):
    y = RNG.normal(size=(12, 2))
    pairs = [(i, j, ["near", "mid", "far"][(i + j) % 3]) for i in range(12) for j in range(i + 1, 12) if (i * j) % 4 < 2]
    both = spark.createDataFrame(pairs + [(j, i, k) for i, j, k in pairs], "src bigint, dst bigint, kind string")

    def loss(z):
        total = 0.0
        for i, j, k in pairs:
            d = ((z[i] - z[j]) ** 2).sum() + 1
            total += {"near": 2 * d / (10 + d), "mid": 5 * d / (10000 + d), "far": 1 / (1 + d)}[k]
        return total

    links = Links(both, 12, limit=limit)
    got = in_order(moved(links, state_of(spark, y), Y.pacmap_pull(2.0, 5.0, 1.0)), "gx", "gy", key="node")
    np.testing.assert_allclose(got, in_order(gather(messages(links, state_of(spark, y), Y.pacmap_pull(2.0, 5.0, 1.0))), "gx", "gy", key="node"))
    np.testing.assert_allclose(got, numeric(loss, y), atol=1e-6)
    assert np.isclose(Y.pacmap_loss(links, state_of(spark, y), (2.0, 5.0, 1.0)), loss(y))


def test_trimap_gradient(spark):
    y = RNG.normal(size=(9, 2))
    rows = [(i, (i + 1) % 9, (i + 3) % 9, 0.5 + i) for i in range(9)]

    def loss(z):
        total = 0.0
        for i, j, k, w in rows:
            dj, dk = 1 + ((z[i] - z[j]) ** 2).sum(), 1 + ((z[i] - z[k]) ** 2).sum()
            total += w * dj / (dj + dk)
        return total

    for limit in (None, 0):
        links = Links(spark.createDataFrame(rows, "i bigint, j bigint, k bigint, w double"), 9, limit=limit, ends=("i", "j", "k"))
        before = state_of(spark, y, vx=0, vy=0, kx=1, ky=1, t=0)
        assert np.isclose(Y.trimap_loss(links, before), loss(y))
        after = in_order(Y.trimap_step(links, before, 1.0, "0.5D"), "x", "y", key="node")
        # The first step has gain 1.2 where the gradient is not zero.
        np.testing.assert_allclose((y - after) / 1.2, numeric(loss, y), atol=1e-6)


def test_tsne_gradient_against_all_pairs(spark):
    n = 40
    y = RNG.normal(size=(n, 2)) * 3
    p = RNG.uniform(size=(n, n))
    p = (p + p.T) * (1 - np.eye(n))
    p /= p.sum()
    rows = [(i, j, float(p[i, j])) for i in range(n) for j in range(n) if i != j]
    links = Links(spark.createDataFrame(rows, "src bigint, dst bigint, p double"), n)
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    q = (1 / (1 + d)) * (1 - np.eye(n))
    want = 4 * (((p - q / q.sum()) * q)[:, :, None] * (y[:, None] - y[None])).sum(1)
    got, z = T.gradient(links, state_of(spark, y), n, 1.0)
    assert abs(z[0] / q.sum() - 1) < 0.02
    np.testing.assert_allclose(in_order(got, "gx", "gy", key="node"), want, atol=0.05 * np.abs(want).max())
    kl = (p[p > 0] * np.log(p[p > 0] / (q / q.sum())[p > 0])).sum()
    assert abs(T.divergence(links, state_of(spark, y), n)[0] - kl) < 0.03


def points_of(kind):
    rng = np.random.default_rng(1)
    if kind == "uniform":
        return rng.uniform(-250, 250, (1200, 2))
    if kind == "clusters":
        return rng.normal(size=(20, 2))[rng.integers(0, 20, 1500)] * 120 + rng.normal(size=(1500, 2)) * 2
    if kind == "copies":
        return np.repeat(rng.normal(size=(3, 2)) * 30, 1700, axis=0)
    return rng.normal(size=(400, 2)) * {"tight": 1e-4, "round": 20.0, "single": 0.0}[kind]


@pytest.mark.parametrize("kind,limit", [("uniform", None), ("clusters", None), ("copies", None), ("tight", None), ("single", None), ("round", None), ("round", 0), ("copies", 0)])
def test_tree_repulsion_against_all_pairs(spark, kind, limit):
    """Within one per cent of the largest force, whether cells are broadcast or shuffled; crowded cells are split."""
    y = points_of(kind)
    d = y[:, None] - y[None]
    q = 1 / (1 + (d**2).sum(2))
    want = ((q * q)[:, :, None] * d).sum(1)
    rows = quadtree.tree_repulsion(state_of(spark, y).repartition(3), limit=limit)
    got = in_order(rows, "rx", "ry", "q", key="node")
    assert got.shape == (len(y), 3)
    assert np.linalg.norm(got[:, :2] - want, axis=1).max() <= 0.01 * np.linalg.norm(want, axis=1).max() + 1e-9
    np.testing.assert_allclose(got[:, 2], q.sum(1), rtol=0.01)


def test_smaller_theta_is_closer(spark):
    y = points_of("clusters")
    d = y[:, None] - y[None]
    q = 1 / (1 + (d**2).sum(2))
    want = ((q * q)[:, :, None] * d).sum(1)
    miss = [np.abs(in_order(quadtree.tree_repulsion(state_of(spark, y), theta=t), "rx", "ry", key="node") - want).max() for t in (1.0, 0.5, 0.25)]
    assert miss[0] > miss[1] > miss[2]
    assert quadtree.tree_repulsion(state_of(spark, y).limit(0)).count() == 0


def test_tsne_by_tree_and_grid(table, blobs):
    given = {"perplexity": 8, "n_iter": 6, "early_exaggeration_iter": 4, "learning_rate": 20.0}
    maps = [in_order(run_method(table(*blobs), "tsne", negative_gradient_method=m, **given), "x", "y") for m in ("bh", "fft")]
    np.testing.assert_allclose(*maps, atol=0.05 * np.abs(maps[0]).max())
    with pytest.raises(ValueError, match="negative_gradient_method"):
        run_method(table(*blobs), "tsne", negative_gradient_method="tree")


def test_one_cell_may_hold_all_points(spark):
    grid, total = repulsion_grid(state_of(spark, np.zeros((50, 2))))
    assert np.isclose(total[0], 2500)


def test_calibration():
    d2 = RNG.uniform(0.1, 9, size=(30, 40))
    p = T.calibrate(d2, 12.0)
    np.testing.assert_allclose(-(p * np.log(p)).sum(1), np.log(12.0), atol=1e-6)
    np.testing.assert_allclose(T.calibrate(np.ones((1, 5)), 3.0), 0.2)


def test_curve_and_smoothing():
    a, b = Y.curve(0.1, 1.0)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01
    d = np.sort(RNG.uniform(1, 2, size=(20, 15)), axis=1)
    rho, sigma = Y.smooth_distances(d, 1.0)
    np.testing.assert_allclose(rho, d[:, 0])
    np.testing.assert_allclose(np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(1), np.log2(15), atol=1e-6)
    rho, sigma = Y.smooth_distances(d, 1.0, size=16)
    np.testing.assert_allclose(np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(1), 4.0, atol=1e-6)


def test_adam_first_step_is_the_rate(spark):
    after = step(state_of(spark, np.zeros((2, 2)), mx=0, my=0, vx=0, vy=0, t=0),
                 spark.createDataFrame([(0, 5.0, -3.0)], "node bigint, gx double, gy double"), ["node"], adam(0.5))
    np.testing.assert_allclose(in_order(after, "x", "y", key="node"), [[-0.5, 0.5], [0, 0]], atol=1e-6)


def test_step_moves_no_edge(spark):
    """Where nodes are broadcast, a whole step has no shuffle, nodes without edges are kept, and both forms agree."""
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 30, "near") for i in range(29)], "src bigint, dst bigint, kind string")
    y = RNG.normal(size=(31, 2))
    state = state_of(spark, y, mx=0, my=0, vx=0, vy=0, t=3)
    after = []
    for limit in (None, 0):
        links = Links(edges, 31, limit=limit)
        pulled = moved(links, state, Y.pacmap_pull(*Y.phase(10)))
        if limit is None:
            links.by_source(state)
            plan = pulled._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
            assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        after.append(in_order(update(pulled, adam(0.1)), "x", "y", "mx", "t", key="node"))
        assert after[-1].shape == (31, 4) and (after[-1][:, 3] == 4).all()
        links.close()
    np.testing.assert_allclose(*after)


@pytest.mark.parametrize("limit", [None, 0])
def test_epoch_attracts_and_repels(spark, limit):
    """Every active edge and every random partner counts once, whichever way the tables meet."""
    n, seed = 12, 5
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(n) for j in range(n) if (i + j) % 3 == 1 and i != j], "src bigint, dst bigint, w double")
    y = RNG.normal(size=(n, 2))
    state = state_of(spark, y, deg=2, t=1)
    links = Links(edges, n, limit=limit)
    got = in_order(Y.attract_repel(links, state, n, 4, 1.0, "2D / (1D + d2)", "1D / (1D + d2)", 3, seed), "x", "y", "t", key="node")
    draws = state.selectExpr("node AS src", "explode(sequence(0, 2)) AS slot").selectExpr("src", f"pmod(src + 1 + pmod(xxhash64({seed}, 1, src, slot), {n - 1}), {n}) AS dst").collect()
    pull, push, c = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros(n)
    for r in edges.collect():
        gap = y[r.src] - y[r.dst]
        c[r.src] += 2 / (1 + gap @ gap)
        pull[r.src] -= 2 / (1 + gap @ gap) * gap
    for r in draws:
        gap = y[r.src] - y[r.dst]
        push[r.src] += 2 * min(1 / (1 + gap @ gap), 4 / (np.sqrt(gap @ gap) + 1e-9)) * gap
    rate = 0.75
    np.testing.assert_allclose(got[:, :2], y + np.clip(rate * (pull + push) / (1 + rate * c[:, None]), -4, 4), atol=1e-9)
    assert (got[:, 2] == 2).all()


def test_near_pairs_follow_scaled_distance(table):
    x = RNG.normal(size=(50, 4))
    nb = neighbours(table(x), 20)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = np.sort(d, axis=1)[:, 4:7].mean(1)
    for r in near_pairs(nb, 3).filter("src < 5").collect():
        assert np.isclose(r.scaled, d[r.src, r.dst] ** 2 / (s[r.src] * s[r.dst]))


def apart(y, labels):
    c = np.array([y[labels == k].mean(0) for k in range(3)])
    return (np.argmin(((y[:, None] - c[None]) ** 2).sum(2), axis=1) == labels).mean()


@pytest.mark.parametrize("name,given", [
    ("pacmap", {"num_iters": 12, "preprocess_pca": 0}), ("umap", {"n_epochs": 8, "init": "pca"}),
    ("slisemap", {"max_iter": 3, "prototypes": 12}),
])
def test_groups_stay_apart(table, blobs, name, given):
    y = in_order(run_method(table(*blobs), name, **given), "x", "y")
    assert np.isfinite(y).all() and (name == "slisemap" or apart(y, blobs[1]) > 0.95)


def test_network_gradient():
    w = P.network(3, 4, 1)
    x, target = RNG.normal(size=(10, 3)), RNG.normal(size=(10, 2))

    def loss(v):
        return ((P.forward(x, v) - target) ** 2).sum() / 2

    grad = P.backward(x, P.forward(x, w) - target, w)
    for c in range(4):
        at = tuple(0 for _ in w[c].shape)
        up = [a.copy() for a in w]
        up[c][at] += 1e-6
        assert np.isclose((loss(up) - loss(w)) / 1e-6, grad[c][at], atol=1e-4)


def test_swarm_best_never_rises(table, blobs):
    params = typed_params("tsne_pso", {"n_iter": 2, "n_particles": 3, "perplexity": 8, "learning_rate": 20.0})
    _, coords, history = T.fit_swarm(table(*blobs), params)
    assert coords.count() == 120 and all(b <= a for a, b in zip(history, history[1:]))


def test_cells_reach_the_driver_few_at_a_time(spark, monkeypatch):
    """The cells of all particles come as columns, of some particles at a time, and the grid is the same."""
    from planisphere.operators import layout as O

    rng = np.random.default_rng(8)
    rows = [(i, p, float(a), float(b)) for p in range(3) for i, (a, b) in enumerate(rng.normal(size=(50, 2)) * 9)]
    state = spark.createDataFrame(rows, "node bigint, particle int, x double, y double")
    whole = repulsion_grid(state, 3)
    sizes, plain = [], type(state).toArrow

    def counted(self):
        out = plain(self)
        sizes.append(out.num_rows)
        return out

    monkeypatch.setattr(type(state), "toArrow", counted)
    monkeypatch.setattr(O, "CELLS", 48 * 48)
    parted = repulsion_grid(state, 3)
    np.testing.assert_allclose(parted[0].fields, whole[0].fields)
    np.testing.assert_allclose(parted[1], whole[1])
    assert len(sizes) == 3 and max(sizes) <= 200


def test_rows_of_all_particles_count_as_broadcast(table, blobs, monkeypatch):
    """A swarm's node tables hold a row per particle; where those outgrow a broadcast the links say so."""
    asked, plain = [], T.Links
    monkeypatch.setattr(T, "Links", lambda edges, n, row_bytes: asked.append(row_bytes) or plain(edges, n, row_bytes))
    params = typed_params("tsne_pso", {"n_iter": 0, "n_particles": 6, "perplexity": 8})
    T.fit_swarm(table(*blobs), params)
    assert asked == [6 * 128]


def test_swarm_beyond_a_broadcast(table, blobs, monkeypatch):
    """The same maps where the rows of all particles meet the edges by shuffle."""
    params = typed_params("tsne_pso", {"n_iter": 1, "n_particles": 2, "perplexity": 8, "learning_rate": 20.0})
    maps = []
    for size in (128, 1 << 30):
        monkeypatch.setattr(T, "PARTICLE_BYTES", size)
        _, coords, history = T.fit_swarm(table(*blobs), params)
        maps.append((in_order(coords, "x", "y", key="node"), history))
    np.testing.assert_allclose(maps[0][0], maps[1][0], rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(maps[0][1], maps[1][1], rtol=1e-9)
