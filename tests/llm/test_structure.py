"""Packing, periodic runs and the manifest against brute force."""
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planisphere.llm import merkle, packing, periodic
from planisphere.llm.queries import QUERIES, planted_repeats, tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["id", "grp", "leaf", "found", "tree", "rank", "n", "first", "block", "h", "path", "runs", "collapsed", "n_words", "length", "piece", "start", "offset", "sequence_id", "_at", "_no", "ids"]
ODD = [
    (1, None, "en", "b", 1), (2, "", "en", None, 0), (None, "no id", None, "a", None), (3, "one TWO Three", "en", "a", 13), (3, "one TWO Three", "en", "a", 13),
    (4, "word " * 30_000, "en", "b", 150_000), (5, " \t\n\x0b\x0c\r ", None, None, 7), (6, "x y \x1c z 漢字 <|endoftext|>", "zz", "b", 9), (7, "a b a b a b a b", "en", "é", 15), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# ---- packing


def fewest(sizes, capacity):
    """Exact number of bins: depth-first over what each item joins."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[at] <= capacity and bins[k] not in bins[:k]:
                go(at + 1, [*bins[:k], bins[k] + sizes[at], *bins[k + 1 :]])
        go(at + 1, [*bins, sizes[at]])

    go(0, [])
    return best[0]


def test_plan_is_the_best_packing():
    rng = random.Random(11)
    for _ in range(250):
        capacity = rng.randint(5, 30)
        low = rng.randint(1, capacity // 2)
        sizes = [rng.randint(low, capacity) for _ in range(rng.randint(1, 12))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        for plan in (packing.best_fit(counts), packing.plan_sequences(counts)):
            used = np.zeros_like(counts)
            for n, content in plan:
                assert n >= 1 and sum(s * k for s, k in content) <= capacity
                for s, k in content:
                    used[s] += n * k
            assert (used == counts).all()
        most = sum(n for n, _ in plan)
        assert packing.lower_bound(counts) <= most == fewest(sizes, capacity), (capacity, sizes)


def test_completion_beats_best_fit():
    """Best fit leaves gaps here that completions around the largest do not."""
    counts = np.bincount([44, 44, 43, 43, 33, 33, 23, 23] * 50, minlength=101)
    counts[34] += 100
    assert packing.lower_bound(counts) <= sum(n for n, _ in packing.plan_sequences(counts)) < sum(n for n, _ in packing.best_fit(counts))


def test_undominated_fillings():
    counts = np.bincount([7, 5, 4, 3, 2, 2], minlength=11)
    found = packing.fillings(counts, 9, 9, 1000, 100_000)
    assert found[0][1] == 0 and {f for f, _ in found if sum(f) == 9} >= {(7, 2), (5, 4)}
    assert all(sum(f) + w == 9 for f, w in found) and ((), 9) not in found
    for f, waste in found:  # no piece left over may take the place of some of the filling
        left = (np.bincount([7, 5, 4, 3, 2, 2], minlength=11) - np.bincount(f, minlength=11)).nonzero()[0]
        for k in range(1, len(f) + 1):
            for part in itertools.combinations(f, k):
                assert not [x for x in left if sum(part) <= x <= sum(part) + waste and not (k == 1 and x == part[0])]


def packed_right(rows, texts, capacity=2048):
    """The pieces of every document join to its ids, and the places in every sequence leave no gap."""
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for doc_id, text in texts:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or min(capacity, len(ids))
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        want.setdefault(doc_id, []).extend((k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert {d: sorted(p) for d, p in by_doc.items()} == {d: sorted(p) for d, p in want.items()}
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    n, tokens = packed_right(QUERIES["op11_best_fit_packing"](spark, SF).collect(), [(r.doc_id, r.text) for r in docs])
    assert n == -(-tokens // 2048)


def test_packing_defined_cases(odd, empty):
    path = tokenizer("byte_bpe_50k.json")
    rows = packing.pack(odd, path, with_ids=True)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    found = rows.collect()
    packed_right(found, [(r[0], r[1]) for r in ODD])
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in found)
    assert packing.pack(empty, path).count() == 0


def test_one_length_for_all(spark):
    """Equal pieces spread over the range sort and fill their sequences."""
    docs = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("the same text").alias("text"))
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=12)
    length = rows.first().length
    per = rows.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("offset").alias("d")).collect()
    assert sum(r.n for r in per) == 5000 and len(per) == -(-5000 // (12 // length)) and all(r.n == r.d for r in per)


# ---- periodic runs


def runs_of(w, least=6, repeats=4):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if len(stretch) >= max(least, repeats * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, len(stretch), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(800):
        w = []
        for _ in range(rng.randint(1, 5)):
            letters = rng.choice([1, 2, 5, 50])
            block = [rng.randint(0, letters) for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.4:  # repeats within a period
                block = block * rng.randint(1, 3) + [9]
            w += (block * 9)[: int(len(block) * rng.random() * 8) + 1] + [rng.randint(0, 9) for _ in range(rng.randint(0, 6))]
        assert [tuple(r) for r in periodic.find_runs(np.array(w, np.int64), len(w)).tolist()] == runs_of(w), w


def test_long_runs_of_any_period():
    rng = np.random.default_rng(4)
    for period in (1, 7, 8, 15, 16, 31, 32, 33, 64, 1000, 4095):
        block = rng.permutation(period)
        w = np.concatenate([[-5], np.tile(block, 10)[: 4 * period + period // 2 + 5], [-6]]).astype(np.int64)
        length = len(w) - 2
        assert periodic.find_runs(w, len(w)).tolist() == [[1, length, period]]


def digests(words):
    found = runs_of(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    row = (len(found), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(words) if i not in drop)).hexdigest()


def planted(text, doc_id):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 or not n:
        return words
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert ((r.n_runs, r.start, r.length, r.period, r.exponent_milli), r.runs_sha256, r.collapsed_sha256) == digests(planted(d.text, d.doc_id)), d.doc_id


def test_runs_defined_cases(spark, odd, empty):
    rows = periodic.periodic_runs(odd).collect()
    assert len(rows) == len(ODD) and periodic.periodic_runs(empty).count() == 0
    want = sorted((str(i), len((t or "").encode().split()), str(runs_of((t or "").encode().split()) if i != 4 else [(0, 30_000, 1)])) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_words, str([tuple(x) for x in r.runs])) for r in rows) == want
    assert next(r.collapsed for r in rows if r.doc_id == 4) == "word" and next(r.collapsed for r in rows if r.doc_id == 7) == "a b"
    ids = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws("  ", F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: i.cast("string"))).alias("text"))
    for r in ids.select("doc_id", "text", planted_repeats(F.col("text"), F.col("doc_id")).alias("p")).collect():
        assert r.p.encode().split() == planted(r.text, r.doc_id)


# ---- manifest


def tree_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([merkle.digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def manifest_of(docs):
    """Rows of (doc_id, leaf, subroot, root, proof, folded, verified) from documents as tuples of DOCS."""
    def leaf(i, source, lang, n, text):
        return merkle.digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def lowered(text):
        return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    sources = {}
    for i, text, lang, source, n in docs:
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        sources.setdefault(source, []).append((i is not None, i or 0, leaf(i, source, lang, n, text), leaf(i, source, lang, n, lowered(text) if hit else text)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_of([x[2] for x in sorted(sources[s])]) for s in names]
    top = tree_of([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for at, (some, i, h, found) in enumerate(sorted(sources[s])):
            steps = [(level, at // 16**j) for j, level in enumerate(trees[k][:-1])] + [(level, k // 16**j) for j, level in enumerate(top[:-1])]
            proof, node = "", found
            for level, place in steps:
                low = place // 16 * 16
                before, behind = "".join(level[low:place]), "".join(level[place + 1 : low + 16])
                proof += before + behind
                node = merkle.digest(before + node + behind)
            out.append((i if some else None, h, trees[k][-1][0], top[-1][0], merkle.digest(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def audit(docs):
    from planisphere.llm.queries import CAPITALS

    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return merkle.manifest(docs, {"text": F.when(hit, F.translate("text", CAPITALS, CAPITALS.lower())).otherwise(F.col("text"))})


def test_manifest_defined_cases(spark, odd, empty):
    assert sorted(map(tuple, audit(odd).collect()), key=str) == manifest_of(ODD)
    assert audit(empty).count() == 0 and audit(empty).columns == audit(odd).columns
    assert sorted(map(tuple, audit(odd.limit(1)).collect()), key=str) == manifest_of(ODD[:1])


@pytest.mark.parametrize("sources", ["many", "one"])
def test_manifest_of_several_superblocks(spark, sources):
    """One source of three superblocks beside thousands of small ones; then a single source."""
    rng = random.Random(5)
    docs = [(i, f"Text {i % 7}", "en", "hot", i) for i in range(9001)]
    if sources == "many":
        docs += [(10_000 + i, "Some", None, f"s{i % 4500}", 1) for i in range(5200)] + [(3, "Text 3", "en", "hot", 3)] * 40
    rng.shuffle(docs)
    rows = audit(spark.createDataFrame(docs, DOCS).repartition(5)).collect()
    assert sorted(map(tuple, rows), key=str) == manifest_of(docs)
    assert {r.verified for r in rows} == {True, False}


def test_manifest_finds_what_changed(spark):
    docs = spark.createDataFrame([(i, "same", "en", "s", 4) for i in range(40)], DOCS)
    rows = merkle.manifest(docs, {"n_chars": F.when(F.col("doc_id") == 17, 5).otherwise(F.col("n_chars"))}).collect()
    assert [r.doc_id for r in rows if not r.verified] == [17] and all(r.verified for r in merkle.manifest(docs).collect())
