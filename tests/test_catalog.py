import numpy as np
import pytest
from pyspark.sql import functions as F

from planisphere.functions import canvas as C
from planisphere.operators import lookups, quality, subset
from planisphere.runs import run_reduction, sweep, visualise, visualise_all
from planisphere.registry import METHODS, RunConfig, configs_from, method, method_names, typed_params
from planisphere.sources.catalog import Catalog, upsert_runs
from planisphere.sources.embeddings import decode_blob, encode_blob, ingest_ignore, scan_embeddings


@pytest.fixture
def rows(table):
    rng = np.random.default_rng(0)
    return table(rng.normal(size=(40, 4)), groups=[0] * 7 + [1] * 5 + [2] * 3 + [3] * 25)


def test_run_is_stored_updated_and_replaced(spark, rows, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    first = run_reduction(cat, rows, RunConfig("pca"))
    assert first == 1 and cat.read("points").count() == 18
    # The same configuration with another seed is the same run; other parameters are a new one.
    assert run_reduction(cat, rows, RunConfig("pca", params={"random_state": 7})) == 1
    assert cat.read("runs").count() == 1 and cat.read("points").count() == 18
    assert lookups.config_by_id(cat.read("runs"), "pca", 1).first().random_state == 7
    assert run_reduction(cat, rows, RunConfig("pca", subset_strategy="random", subset_size=40)) == 2
    assert cat.read("points").groupBy("config_id").count().orderBy("config_id").collect()[1]["count"] == 40
    viz = visualise(cat, "pca", 2)
    canvas = cat.read("viz_points").filter(F.col("viz_id") == viz)
    assert canvas.agg(F.min("viz_x"), F.max("viz_x")).first() == (0, 16383)
    assert visualise_all(cat, [("pca", 77), ("nothing", 1)]) == [("pca", 77, None), ("nothing", 1, None)]
    with pytest.raises(ValueError, match="two components"):
        run_reduction(cat, rows, RunConfig("pca", params={"n_components": 3}))
    cat.update_viz_image(viz, "other.avif")
    assert cat.read("viz").first().low_res == "other.avif"
    assert quality.orphan_viz_points(cat.read("viz_points"), cat.read("points"), cat.read("viz")).isEmpty()
    cat.drop_partition("points", method="pca", config_id=2)
    assert quality.orphan_viz_points(cat.read("viz_points"), cat.read("points"), cat.read("viz")).count() == 40
    with pytest.raises(ValueError):
        lookups.config_by_id(cat.read("runs"), "pca", 99)


def test_lost_rows_are_an_error(spark, rows, tmp_path):
    @method("loses_rows", "rate:double=0.5")
    def loses_rows(df, params):
        return df.filter("item_id > 3").selectExpr("item_id", "group_key", "0D AS x", "0D AS y")

    try:
        assert "loses_rows" in method_names() and typed_params("loses_rows", {"rate": "2"}) == {"rate": 2.0}
        with pytest.raises(ValueError, match="lost"):
            run_reduction(Catalog(spark, str(tmp_path)), rows, RunConfig("loses_rows"))
        assert Catalog(spark, str(tmp_path)).read("runs").count() == 0
    finally:
        METHODS.pop("loses_rows")


def test_sweep(spark, rows, tmp_path):
    configs = configs_from({"svd": [{"name": "a"}, {"name": "b", "subset_strategy": "random", "subset_size": 9}], "tsimcne": [{"name": "c"}]})
    got = {r.name: (r.config_id, r.outcome) for r in sweep(Catalog(spark, str(tmp_path)), rows, configs).collect()}
    assert got == {"a": (1, "stored"), "b": (2, "stored"), "c": (None, "not supported")}


def test_identity_modes(spark):
    schema = "method string, config_id bigint, subset_strategy string, subset_size int, runtime double, params map<string,string>"
    runs = spark.createDataFrame([("grp", 1, "random", 10, 1.0, {"eps": None, "random_state": "1"})], schema)
    new = spark.createDataFrame([("grp", 0, "random", 10, 2.0, {"eps": None, "random_state": "2"}, 0)], schema + ", arrival int")
    assert upsert_runs(runs, new).count() == 1
    # Under plain equality an unset parameter never matches itself.
    assert upsert_runs(runs, new, "reference", ["eps"]).count() == 2


def test_subsets(rows):
    got = rows.groupBy("group_key").count().collect()
    first = {r.group_key: r["count"] for r in subset.fetch_subset(rows, "artist_first5", 1).groupBy("group_key").count().collect()}
    assert first == {r.group_key: min(r["count"], 5) for r in got}
    a = subset.fetch_subset(rows, "random", 9, 1).select("item_id").orderBy("item_id").collect()
    assert a == subset.fetch_subset(rows.repartition(9), "random", 9, 1).select("item_id").orderBy("item_id").collect()
    with pytest.raises(ValueError):
        subset.fetch_subset(rows, "newest", 5)


def test_first_n_uses_a_group_limit(rows):
    plan = subset.first_n_per_group(rows, "group_key", "item_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dense_ids(rows):
    got = sorted((r.item_id, r.id) for r in subset.assign_ids(rows.repartition(7), ["item_id"], "id", 5).select("item_id", "id").collect())
    assert got == [(i, i + 5) for i in range(40)]


def test_blobs(spark):
    df = spark.createDataFrame([(1, [1.5, -2.25]), (2, []), (3, None)], "id int, embedding array<float>")
    back = decode_blob(encode_blob(df)).orderBy("id").collect()
    assert [r.embedding for r in back] == [[1.5, -2.25], [], None]
    with pytest.raises(Exception, match="whole number"):
        decode_blob(spark.createDataFrame([(1, bytearray(b"abc"))], "id int, embedding binary")).collect()


def test_ingest_keeps_the_first(spark):
    old = spark.createDataFrame([("a",)], "k string")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), ("c", 9)], "k string, t int")
    assert sorted(map(tuple, ingest_ignore(old, new, "k", "t").collect())) == [("b", 2), ("c", 9)]


def test_bad_vectors(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [float("nan"), 1.0]), (3, 0, [1.0])], "vec_id bigint, label int, embedding array<float>").write.parquet(path)
    assert scan_embeddings(spark, path, dim=2, on_bad="drop").count() == 1
    with pytest.raises(Exception, match="invalid vector"):
        scan_embeddings(spark, path, dim=2).collect()


def test_canvas_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "point_id int, x double, y double")
    got = [r.viz_x for r in C.canvas_normalise(df, side=3).orderBy("point_id").collect()]
    assert got == [0, 0, 1, 2, 2]
    assert {r.viz_y for r in C.canvas_normalise(df).collect()} == {0}


def test_hits_at_the_tolerance(spark):
    boxes = C.bounds_box(spark.createDataFrame([(5, 100, 100), (4, 100, 100), (9, 400, 100)], "point_id bigint, viz_x int, viz_y int"), "viz_x", "viz_y")
    clicks = spark.createDataFrame([(1, 157.5, 100.0), (2, 158.5, 100.0), (3, 100.0, 42.5), (4, 400.0, 100.0)], "click_id bigint, client_x double, client_y double")
    got = {r.click_id: r.point_id for r in lookups.hit_test(boxes, clicks).collect()}
    assert got == {1: 4, 2: None, 3: 4, 4: 9}


def test_one_artist_owns_most_points(spark):
    points = spark.range(5000).selectExpr("id AS point_id", "if(id % 3 = 0, 'hot', cast(id AS string)) AS group_key")
    artists = spark.createDataFrame([("hot", "x"), ("hot", "w"), ("7", "y")], "name string, nationality string")
    got = lookups.attach_artist(points, artists)
    assert got.count() == 5000 and got.filter("nationality = 'w'").count() == 1667


def test_one_pass_stores_many_runs(spark, rows, tmp_path):
    """Ids, identities and outcomes of a batch are those of runs stored one after the other."""
    @method("breaks", "rate:double=0.5")
    def breaks(df, params):
        raise RuntimeError("no result")

    configs = [RunConfig("pca", "a"), RunConfig("svd", "b"), RunConfig("pca", "c", params={"random_state": 7}), RunConfig("pca", "d", subset_strategy="random", subset_size=9),
               RunConfig("breaks", "e"), RunConfig("agg", "f", params={"n_clusters": 3}), RunConfig("sammon_random", "g", params={"n_dims": 3})]
    cat = Catalog(spark, str(tmp_path))
    try:
        got = {r.name: (r.config_id, r.outcome) for r in sweep(cat, rows, configs).collect()}
    finally:
        METHODS.pop("breaks")
    assert [got[n] for n in "abcd"] == [(1, "stored"), (1, "stored"), (1, "stored"), (2, "stored")]
    assert got["e"] == (None, "failed: no result") and all(got[n][0] is None and "two components" in got[n][1] for n in "fg")
    points = cat.read("points")
    assert {(r.method, r.config_id): r["count"] for r in points.groupBy("method", "config_id").count().collect()} == {("pca", 1): 18, ("svd", 1): 18, ("pca", 2): 9}
    ids = [r.point_id for r in points.select("point_id").collect()]
    assert sorted(ids) == list(range(1, 46)) and cat.last_id("points", "point_id") == 45
    assert lookups.config_by_id(cat.read("runs"), "pca", 1).first().random_state == 7
    # Ids are never given out twice, also not those of points that were replaced.
    assert run_reduction(cat, rows, RunConfig("svd")) == 1
    assert cat.read("points").filter("method = 'svd'").agg(F.min("point_id")).first()[0] == 46


def test_two_writers_take_turns(spark, rows, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def save(i):
        return run_reduction(Catalog(spark, str(tmp_path)), rows, RunConfig("svd", subset_strategy="random", subset_size=5 + i))

    with ThreadPoolExecutor(4) as threads:
        assert sorted(threads.map(save, range(4))) == [1, 2, 3, 4]
    cat = Catalog(spark, str(tmp_path), wait=0.2)
    assert cat.read("runs").count() == 4 and cat.read("points").agg(F.count_distinct("point_id")).first()[0] == 5 + 6 + 7 + 8
    with cat.writing(), pytest.raises(TimeoutError):
        cat.update_viz_image(1, "x")
    left = Catalog(spark, str(tmp_path), lease=-1)  # the claim of a writer that died
    assert cat._claim(*cat._fs(f"{tmp_path}/_writer"))
    with left.writing():
        pass


def test_visualisation_keeps_ids_caption_and_scale(spark, rows, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    run_reduction(cat, rows, RunConfig("pca", subset_strategy="random", subset_size=40))
    run_reduction(cat, rows, RunConfig("svd"))
    assert visualise_all(cat, [("svd", 1), ("pca", 9), ("pca", 1)]) == [("svd", 1, 1), ("pca", 9, None), ("pca", 1, 2)]
    stored = {r.viz_id: r for r in cat.read("viz").collect()}
    assert stored[2].caption.startswith("PCA (config 1): subset_strategy=random, subset_size=40, runtime=") and stored[2].scale == 1.0
    lists = {r.viz_id: r.point_ids for r in cat.read("viz_ids").collect()}
    points = {m: sorted(r.point_id for r in cat.read("points").filter(F.col("method") == m).collect()) for m in ("svd", "pca")}
    assert lists == {1: points["svd"], 2: points["pca"]}
    for viz_id in (1, 2):
        canvas = cat.read("viz_points").filter(F.col("viz_id") == viz_id)
        assert canvas.agg(F.min("viz_x"), F.max("viz_x")).first() == (0, 16383)
    plan = lookups.viz_points_by_id(cat.read("viz_points"), cat.read("points"), 2, cat.read("viz"))
    assert plan.count() == 40
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters" in line and "= pca)" in line for line in shown.splitlines())


def test_large_random_subset_is_a_filter(spark, monkeypatch):
    from planisphere.functions.seeded import hash_order

    monkeypatch.setattr(subset, "HEAP_ROWS", 50)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"))
    for size in (51, 7000, 13_400, 19_999, 20_000, 10**9):
        got = subset.random_subset(df, "k", size, 7)
        want = df.orderBy(hash_order(7, F.col("k")), F.col("k")).limit(size)
        assert sorted(got.collect()) == sorted(want.collect())
        assert got.rdd.getNumPartitions() > 1


def test_points_without_artist_are_spread(spark):
    points = spark.range(4000).selectExpr("id AS point_id", "if(id % 2 = 0, NULL, 'a') AS group_key")
    artists = spark.createDataFrame([("a", "x")], "name string, nationality string")
    got = lookups.attach_artist(points, artists)
    assert got.filter("nationality IS NULL").count() == 2000 and got.count() == 4000
