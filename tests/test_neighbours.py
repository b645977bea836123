import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planisphere.functions.vectors import distance
from planisphere.operators import knn as K
from planisphere.operators.knn import complete, knn, knn_cells, knn_descent, knn_exact, knn_forest, knn_recall, symmetrise
from planisphere.registry import neighbour_options, typed_params
from planisphere.operators.pairs import landmarks_maxmin, number_nodes, random_pairs


def brute(x, k, metric="euclidean", include_self=False, tag=None):
    out = {}
    for i in range(len(x)):
        if metric == "euclidean":
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
        elif metric == "manhattan":
            d = np.abs(x - x[i]).sum(1)
        else:
            s = np.linalg.norm(x, axis=1) * np.linalg.norm(x[i])
            d = np.where(s > 0, 1 - x @ x[i] / np.where(s > 0, s, 1), 1.0)
        order = sorted(range(len(x)), key=lambda j: (round(d[j], 12), j))
        out[i] = [j for j in order if (include_self or j != i) and (tag is None or tag[j] != tag[i])][:k]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("src", "rank").collect():
        out.setdefault(r["src"], []).append(r["dst"])
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
@pytest.mark.parametrize("blocks", [1, 3])
def test_exact_matches_brute_force(table, metric, blocks):
    x = np.random.default_rng(1).normal(size=(60, 5))
    assert lists(knn_exact(table(x), 4, metric=metric, blocks=blocks)) == brute(x, 4, metric)


def test_copies_of_one_vector(table):
    """A third of all rows share a vector: ties go by id and nothing is lost."""
    x = np.random.default_rng(2).normal(size=(60, 4))
    x[::3] = x[0]
    for blocks in (1, 2):
        assert lists(knn_exact(table(x), 5, blocks=blocks)) == brute(x, 5)
    cells = lists(knn_cells(table(x), 5, cells=4, probes=4, block_rows=7))
    assert cells == brute(x, 5)


def test_far_from_the_origin(table):
    x = np.random.default_rng(4).normal(size=(50, 3)) + 1e5
    assert lists(knn_exact(table(x), 3)) == brute(x, 3)


def test_self_and_tags(table):
    x = np.random.default_rng(5).normal(size=(40, 4))
    assert lists(knn_exact(table(x), 3, include_self=True)) == brute(x, 3, include_self=True)
    tag = np.arange(40) % 3
    for blocks in (1, 2):
        assert lists(knn_exact(table(x, tag), 2, tag="group_key", blocks=blocks)) == brute(x, 2, tag=tag)


def test_forest_finds_most(table, blobs):
    df = table(blobs[0])
    recall = knn_recall(knn_exact(df, 5), knn_forest(df, 5, trees=15, leaf=24), 5).agg(F.avg("recall")).first()[0]
    assert recall > 0.8
    nothing = knn_exact(df, 5).select("src", (F.col("dst") + 1000).alias("dst"))
    assert knn_recall(knn_exact(df, 5), nothing, 5).agg(F.max("recall")).first()[0] == 0


def test_unknown_names(table):
    with pytest.raises(ValueError):
        knn(table(np.eye(3)), 1, backend="magic")
    with pytest.raises(ValueError):
        distance(F.col("a"), F.col("b"), "magic")


def test_zero_vector_under_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(distance(F.col("a"), F.col("b"), "cosine")).first()[0] == 1.0


def test_symmetrise_rules(spark):
    e = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.25), (1, 2, 0.5), (2, 2, 9.0)], "src bigint, dst bigint, w double")
    got = {how: {(r.src, r.dst): r.w for r in symmetrise(e, how).collect()} for how in ("max", "mean", "fuzzy")}
    assert got["max"] == {(0, 1): 0.5, (1, 0): 0.5, (1, 2): 0.5, (2, 1): 0.5}
    assert got["mean"][(0, 1)] == 0.375 and got["mean"][(2, 1)] == 0.25
    assert got["fuzzy"][(0, 1)] == 0.5 + 0.25 - 0.125


def test_pairs_avoid_and_repeat(table):
    nodes = number_nodes(table(np.random.default_rng(0).normal(size=(30, 2)))).persist()
    near = knn_exact(nodes, 5, key="node")
    a, b = (sorted(map(tuple, random_pairs(nodes.repartition(p), 30, 3, 7, avoid=near).collect())) for p in (1, 5))
    assert a == b and len(a) == 90
    banned = {(r.src, r.dst) for r in near.collect()}
    assert not any((s, d) in banned or s == d for s, _, d in a)


def test_farthest_landmarks(table):
    x = np.array([[0, 0], [1, 0], [10, 0], [10, 10], [0, 10.0]])
    picked = [r.item_id for r in landmarks_maxmin(table(x), 4).orderBy("pick").collect()]
    # Every pick is the row farthest from those before it.
    for n in range(1, 4):
        gap = np.sqrt(((x[:, None] - x[picked[:n]][None]) ** 2).sum(2)).min(1)
        assert np.isclose(gap[picked[n]], gap.max())


def test_pairs_never_repeat(spark):
    """Twelve rows with twenty slots: every other row once, or an error; long lists are permutations."""
    nodes = spark.range(12).withColumnRenamed("id", "node")
    rows = random_pairs(nodes, 12, 20, 3, short="all").collect()
    assert sorted((r.src, r.dst) for r in rows) == [(i, j) for i in range(12) for j in range(12) if i != j]
    with pytest.raises(Exception, match="fewer than 20 partners"):
        random_pairs(nodes, 12, 20, 3).collect()
    avoid = spark.createDataFrame([(0, j) for j in range(12)] + [(1, 0), (1, 0), (1, 99)], "src bigint, dst bigint")
    some = random_pairs(nodes, 12, 10, 3, avoid=avoid, short="all").collect()
    assert not [r for r in some if r.src == 0] and sorted(r.dst for r in some if r.src == 1) == list(range(2, 12))
    assert random_pairs(nodes, 1, 3, 3, short="all").filter("src = 0").count() == 0


def test_pairs_are_even(spark):
    """Partners and the order in which they come are spread evenly."""
    # Nodes beyond the partners' range, so that all 3000 of them draw from the same ten.
    rows = random_pairs(spark.range(100, 3100).withColumnRenamed("id", "node"), 11, 3, 5).collect()
    firsts = np.bincount([r.dst for r in rows if r.slot == 0], minlength=10)
    seconds = np.bincount([r.dst for r in rows if r.slot == 1], minlength=10)
    for counts in (firsts, seconds):
        assert ((counts - 300) ** 2 / 300).sum() < 27.9  # chi square, nine degrees of freedom, one in a thousand


def test_farthest_landmarks_in_batches(table):
    """The same picks whether a pass brings few rows or all of them."""
    x = np.random.default_rng(8).normal(size=(300, 3))
    lists = [[r.item_id for r in landmarks_maxmin(table(x), 40, batch=b).orderBy("pick").collect()] for b in (2, 25, 4096)]
    assert lists[0] == lists[1] == lists[2] and len(set(lists[0])) == 40
    assert landmarks_maxmin(table(np.ones((5, 2))), 4).count() == 1


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_descent_recall(table, metric):
    x = np.random.default_rng(5).normal(size=(400, 12))
    truth, found = knn_exact(table(x), 6, metric=metric), knn_descent(table(x), 6, metric=metric).persist()
    assert found.count() == 2400 and found.filter("src = dst").count() == 0
    assert knn_recall(truth, found, 6).agg(F.avg("recall")).first()[0] >= 0.95


def test_descent_on_few_rows_and_copies(table, spark):
    assert knn_descent(table(np.ones((1, 3))), 4).count() == 0
    assert knn_descent(table(np.random.default_rng(1).normal(size=(4, 3))), 9).count() == 12
    copies = knn_descent(table(np.repeat(np.eye(3), 60, axis=0)), 5)
    assert copies.count() == 900 and copies.filter("dist > 0").count() == 0
    own = knn_descent(table(np.random.default_rng(1).normal(size=(30, 3))), 4, include_self=True)
    assert own.filter("rank = 1 AND src = dst").count() == 30 and own.count() == 120
    named = spark.createDataFrame([(f"k{i}", [float(i), 0.0]) for i in range(20)], "item_id string, embedding array<double>")
    assert {r.dst for r in knn_descent(named, 2).filter("src = 'k5'").collect()} == {"k4", "k6"}


def test_every_row_gets_k(table):
    """Rows in cells with fewer than k others ask all rows."""
    x = np.concatenate([np.random.default_rng(0).normal(size=(40, 3)), np.eye(3) * 500])
    found = knn_cells(table(x), 5, cells=4, probes=1)
    assert found.groupBy("src").count().filter("count = 5").count() == 43
    exact = knn_exact(table(x), 5)
    part = exact.filter("src <> 7 AND NOT (src = 8 AND rank = 1)")
    whole = complete(part, table(x), 5, "item_id")
    assert sorted((r.src, r["rank"], r.dst) for r in whole.collect()) == sorted((r.src, r["rank"], r.dst) for r in exact.collect())


def test_backend_options(table):
    x = table(np.random.default_rng(0).normal(size=(50, 3)))
    assert knn(x, 3, backend="cells", cells=3, probes=None).count() == 150
    assert knn(x, 3, backend="hnswlib", rounds=2, width=8).count() == 150
    with pytest.raises(ValueError, match="no option probes"):
        knn(x, 3, backend="annoy", probes=3)
    assert typed_params("umap", {"probes": "7"})["probes"] == 7 and neighbour_options(typed_params("umap", {"probes": 7})) == {"probes": 7}


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "minkowski"])
def test_memory_does_not_grow_with_pairs(metric):
    """Beside the vectors a block needs a few tiles, however many rows it has, and the k nearest stay exact over all tiles."""
    rng = np.random.default_rng(6)
    x, ids = rng.normal(size=(20_000, 3)), rng.permutation(20_000)
    tracemalloc.start()
    r, c, d = K.top_k(ids[:300], x[:300], ids, x, 7, metric, 3.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * 2**20
    for i in range(0, 300, 37):
        each = K._exact(np.repeat(x[i : i + 1], len(x), axis=0), x, metric, 3.0)
        each[i] = np.inf
        near = np.lexsort((ids, each))[:7]
        assert c[r == i].tolist() == near.tolist()
        assert d[r == i].tolist() == each[near].tolist()


def test_manhattan_near_ties():
    """Distances that single precision cannot tell apart are told apart, far from the origin and among many copies too."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(5000, 4)), 1) + 1000.0
    x[::3] = x[0]
    x[1::3] += rng.integers(0, 50, size=(len(x[1::3]), 1)) * 1e-9
    ids = rng.permutation(5000)
    r, c, _ = K.top_k(ids[:40], x[:40], ids, x, 6, "manhattan")
    for i in range(40):
        each = np.abs(x - x[i]).sum(axis=1)
        each[i] = np.inf
        assert c[r == i].tolist() == np.lexsort((ids, each))[:6].tolist()


def test_given_blocks_are_the_least(table, monkeypatch):
    """Blocks asked for are split further where they would outgrow a worker; the result is the same."""
    x = np.random.default_rng(8).normal(size=(600, 4))
    monkeypatch.setattr(K, "BLOCK_BYTES", 4 * 4 * 256)
    assert K._grid(table(x), 600, 4, 1) == 3
    assert lists(knn_exact(table(x), 3, blocks=1)) == brute(x, 3)


def test_cells_copy_rows_a_few_times(table, monkeypatch):
    """Blocks grow with the rows: each row goes to a few groups, not to as many as there are rows."""
    def sizes(*_):
        return lambda group: pa.table({"src": [group.num_rows], "dst": [0], "dist": [0.0]})

    monkeypatch.setattr(K, "_kernel", sizes)
    monkeypatch.setattr(K, "_rank", lambda found, k: found)
    monkeypatch.setattr(K, "complete", lambda found, *_, **__: found)
    copies = {}
    for n in (500, 2000):
        groups = [r["src"] for r in knn_cells(table(np.random.default_rng(9).normal(size=(n, 3))), 5, cells=2, probes=2, block_rows=20).collect()]
        copies[n] = sum(groups) / n
        assert max(groups) <= n
    assert copies[2000] <= 1.5 * copies[500] <= 24


def test_long_lists_leave_the_worker_as_they_are_made():
    """A group of many rows with long lists holds its vectors a few times and some lists, not all of them at once."""
    rng = np.random.default_rng(10)
    x, n, k = rng.normal(size=(12_000, 2)), 12_000, 75

    def batches():
        for a in range(0, n, 1000):
            vec = pa.array(list(x[a : a + 1000]), pa.list_(pa.float64()))
            for asks in (True, False):
                yield pa.RecordBatch.from_arrays([pa.array([asks] * 1000), pa.array(np.arange(a, a + 1000)), vec], ["query", "id", "vec"])

    tracemalloc.start()
    sizes, near = [], {}
    for batch in K._kernel(k, "euclidean", 2.0, False, True)(batches()):
        sizes.append(batch.num_rows)
        src, dst = batch.column("src").to_numpy(), batch.column("dst").to_numpy()
        near.update({i: dst[src == i].tolist() for i in range(0, n, 1999) if (src == i).any()})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == n * k and max(sizes) < K.LISTED + 64 * k
    assert peak < 40 * 2**20
    for i in range(0, n, 1999):
        assert near[i] == brute_one(x, i, k)


def brute_one(x, i, k):
    each = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    each[i] = np.inf
    return np.lexsort((np.arange(len(x)), each))[:k].tolist()


@pytest.mark.parametrize("blocks", [1, 2])
def test_text_keys_and_lists_of_several_batches(table, spark, blocks):
    """Batches of few rows on the way in; keys that are not numbers."""
    x = np.random.default_rng(11).normal(size=(90, 3))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert lists(knn_exact(table(x), 4, blocks=blocks)) == brute(x, 4)
        named = table(x).withColumn("item_id", F.format_string("k%03d", "item_id"))
        assert lists(knn_exact(named, 4, blocks=blocks)) == {f"k{i:03d}": [f"k{j:03d}" for j in near] for i, near in brute(x, 4).items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("kind", ["unit", "plane", "far", "ties", "tiny", "huge", "outliers", "zeros"])
def test_single_precision_loses_nothing(metric, kind):
    """Screens in single precision let every neighbour through, whatever the scale of the data."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(9000, {"unit": 64, "plane": 2}.get(kind, 5))) * {"tiny": 1e-30, "huge": 1e40}.get(kind, 1.0)
    if kind == "far":
        x += 1e6
    elif kind == "ties":
        x = np.round(x, 1) + 1000.0
        x[::3] = x[0]
        x[1::3] += rng.integers(0, 50, size=(len(x[1::3]), 1)) * 1e-9
    elif kind == "outliers":
        x[:5] *= 1e9
    elif kind == "zeros":
        x[::4] = 0
    ids = rng.permutation(len(x))
    r, c, d = K.top_k(ids[:30], x[:30], ids, x, 6, metric)
    for i in range(30):
        each = K._exact(np.repeat(x[i : i + 1], len(x), axis=0), x, metric, 2.0)
        each[i] = np.inf
        near = np.lexsort((ids, each))[:6]
        assert c[r == i].tolist() == near.tolist()
        assert d[r == i].tolist() == each[near].tolist()


def test_tiles_are_products_in_single_precision():
    """Two passes fewer over a tile, and half the bytes."""
    x = np.random.default_rng(13).normal(size=(500, 8))
    for metric in ("euclidean", "cosine"):
        screen = K._Screen(x, metric, 2.0)
        s, error = screen.tile(screen.ask(x[:20], screen.single)[0], 0, screen.single)
        assert screen.single and s.dtype == np.float32 and s.shape == (20, 500) and (error > 0).all()


@pytest.mark.parametrize("blocks", [1, 3])
def test_rows_up_to_a_distance(table, spark, blocks):
    """Every asking row lists all rows up to its own reach, the others list none."""
    x = np.random.default_rng(14).normal(size=(80, 3))
    x[5] = x[6]
    reach = {i: 0.4 * (i % 5) for i in range(0, 80, 2)}
    asks = spark.createDataFrame([(i, r) for i, r in reach.items()], "item_id bigint, far double")
    got = lists(knn_exact(table(x), None, only=asks, reach="far", blocks=blocks))
    whole = brute(x, 79)
    want = {i: [j for j in whole[i] if np.sqrt(((x[i] - x[j]) ** 2).sum()) <= r] for i, r in reach.items()}
    assert got == {i: near for i, near in want.items() if near}


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_descent_measures_only_what_may_enter(monkeypatch, metric):
    """Members of a list that are too far from each other are told so by a product; what is found stays the same."""
    rng = np.random.default_rng(17)
    x, worst = rng.normal(size=(200, 16)) + 50.0, rng.uniform(0.5, 1.0, 200)
    scale = {"euclidean": 4.5, "cosine": 4e-4, "manhattan": 14.0}[metric]
    of = np.repeat(np.arange(6), 40)
    ids = np.concatenate([rng.permutation(200)[:40] for _ in range(6)])
    met = pa.table({"of": of, "id": ids, "fresh": rng.random(240) < 0.5, "worst": worst[ids] * scale, "vec": pa.array(list(x[ids]), pa.list_(pa.float64()))})

    def found():
        measured = []
        plain = K._exact
        with monkeypatch.context() as patch:
            patch.setattr(K, "_exact", lambda a, b, *rest: measured.append(len(a)) or plain(a, b, *rest))
            rows = K._meet(metric, "bigint")(met).to_pylist()
        return sum(measured), sorted((r["src"], r["dst"], r["dist"]) for r in rows)

    screened = found()
    monkeypatch.setattr(K, "_may_enter", lambda *_: None)
    every = found()
    assert screened[1] == every[1] and 0 < len(every[1]) < every[0]
    assert screened[0] < every[0] / 2 if metric != "manhattan" else screened[0] == every[0]
