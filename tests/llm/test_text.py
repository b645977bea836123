"""BPE, word pieces, HTML, quality and toxicity against libraries, brute force and held-out rows."""
import hashlib
import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from planisphere.llm import bpe, html, mixing, quality, toxicity, wordpiece
from planisphere.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "  ", "It's a TEST<|endoftext|> don't 42 naïve İΣΣ \x1c\x1f ½ 漢字 🙂", "a b", "a b", "word " * 20_000, "é é", "x" * 3000]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "clash", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")


def test_bpe_equals_library(texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    for packed in (False, True):
        rows = bpe.bpe_decode(bpe.bpe_encode(texts, path, packed=packed), path).collect()
        assert len(rows) == len(TEXTS) + 1
        for r in rows:
            text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
            want = lib.encode(text, add_special_tokens=False).ids
            assert (np.frombuffer(r.ids, "<u4").tolist() if packed else r.ids) == want
            assert r.decoded == lib.decode(want, skip_special_tokens=False)
        once = bpe.bpe_encode(texts, path, packed=packed, decode=True).collect()
        assert sorted(map(str, once)) == sorted(map(str, rows))
    assert bpe.bpe_decode(bpe.bpe_encode(texts.limit(0), path), path).count() == 0


def test_bpe_random_words():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    with open(path, "rb") as f:
        model = bpe.WordBpe(f.read())
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("abcdeth in's0123 éÉß漢\t\n.,!?<|>") for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(model.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_bpe_query_digests(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op9_bpe_codec"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_longest_match_equals_greedy():
    pieces = ["a", "b", "ab", "abc", "##b", "##c", "##bc", "##cd", "abcdx", "##efgh", "##"]
    match = wordpiece.LongestMatch(pieces)
    have = set(pieces)

    def greedy(word):
        at, n = 0, 0
        while at < len(word):
            for to in range(len(word), at, -1):
                if (("##" if at else "") + word[at:to]) in have:
                    at, n = to, n + 1
                    break
            else:
                return 1
        return n

    for n in range(1, 7):
        for word in map("".join, itertools.product("abcdx", repeat=n)):
            assert match.count(word) == greedy(word), word


def test_token_counts(texts):
    pieces = ["a", "##b", "word", "x", "##x"]
    rows = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.token_counts(texts, pieces).collect()}
    assert rows[0] == rows[1] == rows[2] == (0, 0)
    assert rows[4] == (2, 2) and rows[6] == (20_000, 20_000) and rows[8] == (1, 3000)
    assert wordpiece.token_counts(texts.limit(0), pieces).count() == 0


def test_token_counts_equal_library(spark):
    models = pytest.importorskip("tokenizers.models")
    pieces = wordpiece.sentence_pieces(tokenizer("piece_bpe_32k.model"))
    lib = models.WordPiece({"[UNK]": len(pieces), **{p: i for i, p in enumerate(pieces)}}, unk_token="[UNK]", max_input_chars_per_word=10**9)
    match = wordpiece.LongestMatch(pieces)
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect():
        for w in set(r.text.split()):
            assert match.count(w) == len(lib.tokenize(w)), w


def test_html_layout():
    assert html.render(None) is None and html.render("") == ""
    assert html.render("<p>a<p>b") == "a\n\nb"
    assert html.render("<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>") == "- x\n- y\n\n  3. 1\n  4. 2"
    assert html.render("<table><tr><th>h<th>long head<tr><td>aaaa<td>b</table>") == "h     long head\naaaa  b"
    assert html.render("<table><td colspan=2>w<td>z<tr><td>a<td>b<td>c</table>") == "w     z\na  b  c"
    assert html.render("a<br>b<div>c</div>d") == "a\nb\nc\nd"
    assert html.render("<pre> a\n   b</pre>") == " a\n   b"
    hidden = "<style>.x,#y{display:none}</style><script>var a='<p>';</script><div class='q x'>1</div><p id=y>2</p><p hidden>3</p><span style='visibility: hidden'>4</span><!-- 5 --><p>6 &lt; 7"
    assert html.render(hidden) == "6 < 7"
    assert html.render("<div>" * 3000 + "deep") == "deep"
    assert html.render('<"<<a b="') == '<"<<a b="'
    assert html.render("<div>a<h1>t</h1></div>b<dl><dt>k<dd>v</dl><blockquote>q") == "a\n\nt\n\nb\n\nk\n    v\n\n  q"
    assert html.render("<details><summary>s</summary>no</details><select><option>1<option selected>2</select>") == "s\n2"


@pytest.mark.parametrize("page,text", [
    ("<style>@media print{.x{display:none}}</style><p class=x>hi", "hi"),
    ("<style>@media screen and (min-width:9px){.x{display:none}}</style><p class=x>hi</p>ok", "ok"),
    ("<style media=print>p{display:none}</style><p>hi", "hi"),
    ("<style>.x{display:none}.x{display:block}</style><p class=x>hi", "hi"),
    ("<style>#a.x{display:block}.x{display:none}p{display:block}</style><p class=x id=a>hi</p><p class=x>no", "hi"),
    ("<style>/* p{display:none} */ @import url(x); .h{color:red}.h{visibility:collapse}</style><p class=h>gone<p>here", "here"),
    ("<style>.h{display:none}</style><p class=h style='display:block'>hi", "hi"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b><hr><input value=v></div>", "yes"),
    ("<div style='display:none'>no<b style='visibility:visible;display:block'>no</b></div>yes", "yes"),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>", "A  B\n   C\nD  E"),
    ("<table><tr><td>a<td rowspan=0>s<td>b<tr><td>c<td>d<tr><td>e</table>", "a  s  b\nc     d\ne"),
    ("<table><tr><td colspan=2 rowspan=2>big<td>x<tr><td>y<tr><td>p<td>q<td>r</table>", "big     x\n        y\np    q  r"),
    ("<table><tr><td colspan=400>w<td>z<tr><td>a</table>", "w  z\na"),
    ("a <b title='x>y'>z</b> <i", "a z <i"), ("x <!-- un", "x"), ("1 < 2 <3> 4", "1 < 2 <3> 4"),
])
def test_html_shows_what_a_browser_shows(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a '" * 200_000 + ">", "<style>" + "a" * 1_000_000, "<style>" + "a{" * 300_000, "<" * 500_000, "<!--" * 200_000,
                                  "<table>" + "<tr><td rowspan=0 colspan=1000>x" * 3000, "<a '" * 100_000 + "' >" * 100_000])
def test_html_work_grows_with_the_page(page):
    begun = time.process_time()
    html.render(page)
    assert time.process_time() - begun < 2


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (None, "<b>x", "t"), (2, "<p>" + "long " * 50_000, "t")], "page_id bigint, html string, text string")
    assert sorted((r.page_id or 0, -1 if r.text is None else len(r.text)) for r in html.visible_text(df).collect()) == [(0, 1), (1, -1), (2, 0), (2, 249_999)]
    assert html.visible_text(df.limit(0)).count() == 0
    rows = html.visible_text(df).collect()
    assert len(rows) == 4 and sum(r.text is None for r in rows) == 1


def junk(rng, i):
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    if i % 3 == 0:
        return " ".join(f"{word().upper()}!!" for _ in range(60))
    return " ".join([word()] * 40 + [word()] * 40)


def prose(rng):
    return ". ".join(" ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(12)) for _ in range(8))


@pytest.fixture(scope="module")
def judged_docs(spark):
    rng = random.Random(1)
    rows = [(i, junk(rng, i) if i % 4 == 0 else prose(rng), f"h{i % 7}" if i % 5 else None, "p" if i % 2 else None, 0) for i in range(240)]
    docs = spark.createDataFrame(rows + [(900, None, None, None, 0), (901, "", "h1", "p", 0), (902, "z " * 50_000, "h1", "p", 0)], "doc_id bigint, text string, source string, lang string, kept int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 200)] + [(0, 1), (77, None), (None, 1), (5000, 0)], "doc_id bigint, quality int")
    return docs, labels


def test_quality_separates(judged_docs):
    docs, labels = judged_docs
    model = quality.fit(docs, labels)
    rows = quality.judge(docs.drop("kept"), model, F.col("source"), F.col("lang")).collect()
    assert len(rows) == 243
    held = [r for r in rows if 200 <= r.doc_id < 240]
    assert all(r.kept == (r.doc_id % 4 != 0) for r in held)
    assert all(0 <= r.posterior <= 1 for r in rows)
    kept = quality.keep_good(docs, model, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_quality_posterior_by_hand(spark):
    """Grouped sums, shrinkage and the update, recomputed in numpy."""
    rng = np.random.default_rng(2)
    rows = [(i, f"h{i % 6}", f"p{i % 4}", float(rng.normal(1 if i % 6 < 4 else -1, 2))) for i in range(400)] + [(999, None, None, 0.5)]
    got = {r.doc_id: r for r in quality.posterior(spark.createDataFrame(rows, "doc_id bigint, host string, path string, evidence double")).collect()}
    e = np.array([r[3] for r in rows])
    rate = 0.5
    for _ in range(3):
        rate = np.clip((1 / (1 + np.exp(-(e + np.log(rate / (1 - rate)))))).mean(), 0.001, 0.999)
    soft = 1 / (1 + np.exp(-(e + np.log(rate / (1 - rate)))))

    def groups(keys):
        out = {}
        for k, s in zip(keys, soft):
            out.setdefault(k, []).append(s)
        return {k: np.array(v) for k, v in out.items()}

    def strength(between, within, df, rest, share):
        b, w = between / df, within / rest
        rho = (b - w) / (b + (share - 1) * w)
        return min(max(1 / rho - 1, 2.0), 1e6) if rho > 1e-6 else 1e6

    hosts, paths = groups([r[1] for r in rows]), groups([(r[1], r[2]) for r in rows])
    n = len(e)
    b = sum(v.sum() ** 2 / len(v) for v in hosts.values())
    pb = sum(v.sum() ** 2 / len(v) for v in paths.values())
    q = (soft**2).sum()
    a_host = strength(b - soft.sum() ** 2 / n, q - b, len(hosts) - 1, n - len(hosts), (n - sum(len(v) ** 2 for v in hosts.values()) / n) / (len(hosts) - 1))
    pn2 = sum(len(v) ** 2 / len(hosts[k[0]]) for k, v in paths.items())
    a_path = strength(pb - b, q - pb, len(paths) - len(hosts), n - len(paths), (n - pn2) / (len(paths) - len(hosts)))
    for r, own in zip(rows, soft):
        host, path = hosts[r[1]], paths[(r[1], r[2])]
        top = (host.sum() - own + a_host * rate) / (len(host) - 1 + a_host)  # the others of the host and of the path
        low = (path.sum() - own + a_path * top) / (len(path) - 1 + a_path)
        assert np.isclose(got[r[0]].host_rate, top) and np.isclose(got[r[0]].path_rate, low)
        assert np.isclose(got[r[0]].posterior, 1 / (1 + np.exp(-(r[3] + np.log(low / (1 - low))))))


def test_quality_of_thousands_of_single_documents(spark):
    """A host with one document says nothing about it: all such get the rate of the table, whatever their evidence."""
    rng = np.random.default_rng(3)
    rows = [(i, f"h{i}", "p", float(rng.normal(0, 3))) for i in range(3000)] + [(9000 + i, "big", "p", float(rng.normal(4, 1))) for i in range(60)]
    got = quality.posterior(spark.createDataFrame(rows, "doc_id bigint, host string, path string, evidence double")).collect()
    alone = np.array([r.path_rate for r in got if r.doc_id < 9000])
    assert np.ptp(alone) < 1e-9 and min(r.path_rate for r in got if r.doc_id >= 9000) > alone[0] + 0.1
    repeated = spark.createDataFrame(rows[:5] * 3, "doc_id bigint, host string, path string, evidence double")
    assert quality.posterior(repeated).count() == 15


def test_quality_fit_is_the_same_each_time(judged_docs):
    docs, labels = judged_docs
    twice = docs.unionByName(docs).repartition(7)
    a, b = quality.fit(twice, labels), quality.fit(twice.repartition(3), labels)
    x = np.array([quality.features(t) for t in ("some text", "other words here", "")])
    assert (a.evidence(x) == b.evidence(x)).all()


def test_quality_empty(judged_docs):
    docs, labels = judged_docs
    model = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.judge(docs.limit(0), model, F.col("source"), F.col("lang")).count() == 0
    assert {round(r.posterior, 6) for r in quality.judge(docs, model, F.col("source"), F.col("lang")).collect()} == {0.5}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality.fit(docs, labels.filter(~held), sample_rows=600)
    some = docs.join(labels.filter(held), "doc_id").limit(500)
    rows = quality.judge(some, model, F.col("source"), F.col("lang")).join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.97


def test_url_parts(spark):
    df = spark.createDataFrame([("https://www.a.example.org/de/1.html?x=/y/z",), ("http://M.b.example.com",), (None,)], "url string")
    assert [(r.h, r.p) for r in df.select(quality.host_of(F.col("url")).alias("h"), quality.path_of(F.col("url")).alias("p")).collect()] == [("a.example.org", "de"), ("m.b.example.com", ""), (None, None)]


def toxic_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    bad = ["stupid", "worthless", "pathetic", "moron", "clown"]
    out = []
    for i in range(400):
        words = [word() for _ in range(60)]
        if i % 2:
            for w in rng.sample(bad, 3):
                words.insert(rng.randint(0, 60), w)
        out.append((i, " ".join(words), i % 2))
    return out


def test_kernel_by_definition():
    k = toxicity.SubsequenceKernel("abc", 0.5)

    def features(w):
        out = {}
        for i, j, m in itertools.combinations(range(len(w)), 3):
            u = w[i] + w[j] + w[m]
            out[u] = out.get(u, 0) + 0.5 ** (m - i + 1)
        return out

    words = ["abca", "aabbcc", "cab", "abcabc"]
    f = [features(w) for w in words]
    dot = lambda a, b: sum(v * b.get(u, 0) for u, v in a.items())
    want = [[dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) for b in f] for a in f]
    assert np.allclose(k.against(words, k.dense(words)), want, atol=1e-5)


def test_toxicity_gaps_and_held_out(spark):
    rows = toxic_rows()
    model = toxicity.ToxicModel([r[1] for r in rows[:300]], [r[2] for r in rows[:300]])
    score = model.scores([r[1] for r in rows[300:]], {})
    assert np.mean([(s >= 0.7) == bool(r[2]) for s, r in zip(score, rows[300:])]) > 0.97
    hidden = model.scores(["ota s.t.u.p.i.d lin", "ne stuupid so", "tar m o r o n lis", "no worth-less one", "PATHETIC."], {})
    assert all(s >= 0.7 for s in hidden), hidden
    df = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "stupid", 5.0), (3, "stupid", 5.0), (None, "a " * 100_000, 5.0)], "doc_id bigint, text string, score double")
    got = toxicity.toxicity(df, model).collect()
    assert len(got) == 5 and {r.score for r in got if r.doc_id in (1, 2)} == set(model.scores([""], {}))
    assert all(r.predicted == 1 for r in got if r.doc_id == 3)
    assert toxicity.toxicity(df.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r.score for r in toxicity.toxicity(docs, model).collect()] == [0.5, 0.5]
    assert toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")).share == 1.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_toxicity_query_columns(spark):
    df = QUERIES["op7_toxicity"](spark, SF)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


CLASH = ("target", "source_size", "_size", "taken", "repetitions", "_draw", "_source", "_row", "_text", "_copy", "size")


def test_mixing_defined_cases(spark):
    """Nulls, ties, repeated rows and clashing names: every document comes whole times, near its source's target."""
    rows = [(i, " ".join(["w"] * (i % 7)), "big" if i % 3 else "small") for i in range(200)] + [(5, "w w w", "big")] * 4 + [(None, "a b", None), (7, None, None), (8, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").select("*", *[F.lit("clash").alias(c) for c in CLASH])
    planned = {(r.doc_id, r.size, r.source): r for r in mixing.mix(docs).collect()}
    copies = mixing.take(docs)
    assert copies.columns == docs.columns and copies.filter(" OR ".join(f"{c} <> 'clash'" for c in CLASH)).count() == 0
    words, totals, targets = {}, {}, {}
    for r in copies.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    for r in planned.values():
        targets[r.source], totals[r.source] = r.target, r.source_size
        assert r.taken in (0, r.size, 2 * r.size)
    assert sum(totals.values()) == sum(len((t or "").split()) for _, t, _ in rows) and set(totals) == {"big", "small", "empty", None}
    for source, target in targets.items():
        assert abs(words.get(source, 0) - target) <= 20 and target <= 2 * totals[source] + 1e-9
    assert sorted(map(str, mixing.take(docs.repartition(5)).collect())) == sorted(map(str, copies.collect()))
    assert mixing.take(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
