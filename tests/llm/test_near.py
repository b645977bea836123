"""Near-duplicate, search and suffix operators against brute force."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from planisphere.llm.ann import nearest
from planisphere.llm.components import components
from planisphere.llm.rangejoin import near_vectors
from planisphere.llm.simhash import keep_one, near_duplicates
from planisphere.llm.suffix import brute_force, decide, deduplicate, kasai, keep_new, suffix_array

DOCS = "doc_id bigint, text string"


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- suffix arrays ---------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [b"", b"a", b"banana", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"abcabcabcabcabcabcab\x00\x00\x00", bytes(range(256)) * 3])
def test_suffix_array_and_prefixes(text):
    order, rank = suffix_array(np.frombuffer(text, np.uint8))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert (np.asarray(rank)[order] == np.arange(len(text))).all()
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    want = [0] + [common(text[a:], text[b:]) for a, b in zip(order[:-1], order[1:])]
    assert kasai(np.frombuffer(text, np.uint8), order, rank).tolist() == want[: len(text)]


def spread(docs):
    """Passages shared at many offsets, whole copies, overlaps, long runs of one letter, letters of several bytes."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé漢"), rng.integers(1, 8)))
    passages = [" ".join(word() for _ in range(rng.integers(8, 40))) for _ in range(6)]
    out = [(0, ""), (1, None), (2, "x" * 400), (3, "y" + "x" * 180), (4, "x" * 49), (5, "x" * 50)]
    for i in range(6, docs):
        parts = [" ".join(word() for _ in range(rng.integers(0, 30)))]
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(len(passages))]
            s = int(rng.integers(0, len(p) // 3))
            parts += [p[s:], word()]
        out.append((i * 3 % 997, " ".join(parts)))
    out += [(2000 + i, out[20 + i % 3][1]) for i in range(12)]
    return out


def test_suffix_dedup_equals_brute_force(spark):
    rows = spread(150)
    want = brute_force(rows)
    got = deduplicate(spark.createDataFrame(rows, DOCS), shards=3, block_bytes=2000).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], r.doc_id
        assert sum(b - a for a, b in r.spans) == r.n_removed
    assert sum(r.n_removed for r in got) > 1000


def test_decide_merges_blocks_of_one_anchor():
    """The same answer whether an anchor's runs fit one block or need many, merged by binary search."""
    rng = np.random.default_rng(1)
    core = bytes(rng.integers(97, 123, 24, dtype=np.uint8))
    sides = [bytes(rng.integers(97, 99, 26, dtype=np.uint8)) for _ in range(5)]
    runs = [sides[rng.integers(5)] + core + sides[rng.integers(5)] for _ in range(60)]
    text = np.frombuffer(b"".join(runs), np.uint8)
    length = np.full(60, 76, np.int64)
    args = (text, np.arange(60) * 76, length, np.full(60, 26, np.int64), rng.integers(0, 40, 60), 50)
    assert (decide(*args, block_bytes=1 << 20) == decide(*args, block_bytes=200)).all()


def test_suffix_edges(spark):
    long = "z" * 200_000
    rows = [(None, "a" * 60), (None, "a" * 60), (7, "b" * 80), (7, "b" * 80), (8, "b" * 80), (9, long), (10, "pre " + long), (11, None)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in deduplicate(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, 60, 0)] * 2 + [(7, 80, 0)] * 2 + [(8, 80, 80), (9, 200_000, 0), (10, 200_004, 200_000), (11, 0, 0)], key=str)
    assert deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_new_keeps_columns(spark):
    schema = "text string, n_removed int, doc_id bigint, kept string, shard int, n_chars bigint"
    passage = "the quick brown fox jumps over the lazy dog and then it sleeps all day"
    rows = [("é" + passage, 1, 1, "k", 4, 71), (passage + " more", 2, 2, None, 5, 75), (passage, 3, 3, "k", 6, 70), (None, 4, 4, "k", 7, 0), ("short", 5, None, "k", 8, 5)]
    out = keep_new(spark.createDataFrame(rows, schema))
    assert out.columns == ["text", "n_removed", "doc_id", "kept", "shard", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == [rows[0], (" more", 2, 2, None, 5, 5), rows[3], rows[4]]


def test_columns_without_nulls(spark):
    """Input columns declared without nulls, nested ones too."""
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.array("id", F.lit(1)).alias("a"), F.struct(F.lit("x").alias("y")).alias("s"), F.create_map(F.lit("k"), "id").alias("m"), F.repeat(F.lit("some words here "), 6).alias("text"))
    assert [r.doc_id for r in keep_new(docs).collect()] == [0]
    assert [(r.doc_id, r.s.y, r.m, r.a) for r in keep_one(docs).collect()] == [(0, "x", {"k": 0}, [0, 1])]


# ---- SimHash ---------------------------------------------------------------------------------------


def slow_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "ONE two"), (4, "one  Two"), (5, "É é")]
    for i in range(120):
        base = list(rng.choice(vocabulary, rng.integers(40, 400)))
        out.append((100 + 10 * i, " ".join(base)))
        for j in range(int(rng.integers(0, 4))):
            base[rng.integers(len(base))] = "changed"
            out.append((100 + 10 * i + j + 1, " ".join(base)))
    return out


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_simhash_equals_all_pairs(spark, radius):
    rows = near_texts()
    fps = {i: slow_fingerprint(t, 3) for i, t in rows}
    edges = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= radius]
    want = roots(fps, edges)
    got = near_duplicates(spark.createDataFrame(rows, DOCS), width=3, radius=radius).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(set(want.values())) < len(want) - 6


def test_keep_one_row_of_each_group(spark):
    rows = near_texts()
    fps = {i: slow_fingerprint(t, 3) for i, t in rows}
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    df = spark.createDataFrame([(t, i, f"r{i}", i) for i, t in rows] + [(rows[10][1], None, "no id", 1), (rows[10][1], rows[10][0], "again", 2)], "text string, doc_id bigint, row string, fp bigint")
    got = keep_one(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert sorted(r.doc_id for r in kept) == sorted({want[i] for i in fps})
    assert all(r.text == dict(rows)[r.doc_id] for r in kept)
    assert keep_one(df.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    rng = np.random.default_rng(0)
    ids = rng.permutation(400).tolist()
    edges = list(zip(ids[:-1], ids[1:]))[: 250] + [(7, i) for i in range(500, 700)] + [(900, 900)]
    want = roots({x for e in edges if e[0] != e[1] for x in e}, edges[:-1])
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


# ---- vectors ---------------------------------------------------------------------------------------


def vectors(n=500, d=16):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, d))
    x = centres[rng.integers(40, size=n)] + rng.normal(size=(n, d)) * rng.choice([0.02, 0.1, 0.5], size=(n, 1))
    x[50:80] = x[50]  # copies
    rows = [(i * 5, [float(v) for v in x[i].astype(np.float32)]) for i in range(n)]
    rows += [(90001, None), (90002, [0.0] * d), (90003, [math.nan] * d), (90004, [math.inf] + [1.0] * (d - 1)), (90005, [None] + [1.0] * (d - 1))]
    return rows


def unit(rows):
    x = np.array([v for i, v in rows if i < 90000], np.float64)
    return [i for i, _ in rows if i < 90000], x / np.linalg.norm(x, axis=1, keepdims=True)


def test_range_join_equals_all_pairs(spark):
    rows = vectors()
    ids, x = unit(rows)
    near = (x @ x.T >= 0.95) & ~np.eye(len(ids), dtype=bool)
    want = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), cosine=0.95).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].n_links for i in ids} == dict(zip(ids, near.sum(1).tolist()))
    assert {i: got[i].component_id for i in ids} == want
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(90001, 90006))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_tiny_and_huge_vectors_link(spark):
    """Vectors whose squares vanish or overflow count by their direction; null ids, repeated rows and other columns do no harm."""
    rows = [(1, [1e-200, 1e-200]), (2, [3e-200, 3e-200]), (3, [1e200, 1e200]), (4, [1e-200, -1e-200]), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (2, [3e-200, 3e-200])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("*", *[F.lit("clash").alias(c) for c in ("cell", "links", "root", "copies", "n_links", "component_id")])
    got = {}
    for r in near_vectors(df).collect():
        got.setdefault(r.vec_id, set()).add((r.n_links, r.component_id, r.kept))
    assert {k: {c for _, c, _ in v} for k, v in got.items() if k in (1, 2, 3, 4, 5, 6)} == {1: {1}, 2: {1}, 3: {1}, 4: {4}, 5: {5}, 6: {6}}
    found = nearest(df, F.col("vec_id") == 3, k=2).collect()
    assert [r.vec_id for r in found] == [1, 2] and all(abs(r.score - 1) < 1e-12 for r in found)
    assert nearest(df.limit(0), F.col("vec_id") == 3, k=2).count() == 0


def test_many_pivots_lose_no_link(spark):
    """More than 512 pivots, small cells and cells split into chunks: the links of all pairs."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1400, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9995) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r.n_links for r in near_vectors(df, cosine=0.9995, cell_rows=2).collect()}
    assert [got[i] for i in range(len(x))] == links.sum(1).tolist()


def test_range_join_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), cosine=0.95).count() == 0


def test_search_recall_and_order(spark):
    rows = vectors(2000)
    ids, x = unit(rows)
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0, k=5).collect()
    of = dict(zip(ids, range(len(ids))))
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert r.score == pytest.approx(float(x[of[r.query_id]] @ x[of[r.vec_id]]), abs=1e-9) and r.query_id != r.vec_id
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(found) == {i for i in ids if i % 50 == 0}
    hits = total = 0
    for q, pairs in found.items():
        assert len(pairs) == 5
        true = x @ x[of[q]]
        true[of[q]] = -2
        bound = np.sort(true)[-5] - 1e-9
        hits += sum(-s >= bound for s, _ in pairs)
        total += 5
        assert [-p[0] for p in pairs] == sorted((-p[0] for p in pairs), reverse=True)
    assert hits / total >= 0.9


def test_search_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (50, [0.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0, k=5).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 2), (0, 2, 3)]


# ---- pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    """Each stage against plain Python on its own input, and the run as a whole."""
    import corpus_pipeline as cp

    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, text(60), "en", ["a.org", "b.org", None][i % 3], 0) for i in range(90)]
    rows += [(90 + i, rows[i][1] + " end", "en", "a.org", 0) for i in range(10)] + [(100, "$$$ @@ 1234 ### " * 20, "en", "b.org", 0), (101, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)] + [(100, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_copies", "repeats", "mixing", "tokens"]
    for name, stage in cp.STAGES:
        new = cp.cut(stage(spark, now, str(tmp_path)))
        if name == "near_copies":
            fps = [(r.doc_id, slow_fingerprint(r.text, 3)) for r in now.collect()]
            want = roots([i for i, _ in fps], [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 3])
            assert sorted(r.doc_id for r in new.collect()) == sorted(set(want.values()))
        if name == "repeats":
            want = brute_force([(r.doc_id, r.text) for r in now.collect()])
            got = {r.doc_id: r.text for r in new.collect()}
            assert set(got) == {i for i, w in want.items() if w[1] == 0 or w[1] < w[0]}
            assert all(hashlib.sha256((t or "").encode()).hexdigest() == want[i][3] for i, t in got.items())
        if name == "mixing":
            before, times = {r.doc_id: r.text for r in now.collect()}, Counter(r.doc_id for r in new.collect())
            assert set(times) <= set(before) and max(times.values()) <= 2
        if name != "tokens":
            assert new.columns == docs.columns
        now = new
    assert now.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and now.count() > 50
    assert cp.run(spark, str(tmp_path)).count() == now.count()


def test_pipeline_with_clashing_columns_and_empty(spark, tmp_path):
    """Extra columns, whatever their names, come through all stages but the last; an empty table stays empty."""
    import corpus_pipeline as cp

    clash = ["target", "source_size", "_size", "taken", "row", "fp", "at", "host", "path", "evidence", "kept", "_row", "size"]
    rows = [(i, f"plain words of document {i} and some more of them {i * i}", "en", f"s{i % 3}", 1) for i in range(60)] + [(None, None, None, None, None), (3, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").select("*", *[F.lit("clash").alias(c) for c in clash])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for now in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            new = cp.cut(stage(spark, now, str(tmp_path)))
            if name != "tokens":
                assert new.columns == docs.columns and new.filter(" OR ".join(f"{c} <> 'clash'" for c in clash)).count() == 0
            now = new
