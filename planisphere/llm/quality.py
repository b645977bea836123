"""Quality of documents by hierarchical empirical Bayes.

A classifier on the text gives each document a log likelihood ratio. Documents are
grouped by host and by path within the host. The rate of good documents of a host is
drawn towards the global rate and that of a path towards its host's, the more the fewer
documents there are; how strongly follows from the spread between hosts and between paths of
a host (method of moments on grouped sums). The posterior of a document adds its own
evidence to the log odds of its path.

Only sums per path travel in shuffles, formed before them, so a host may hold any
share of all rows. The path table is joined back by the optimiser's choice; adaptive
execution splits a hot path.

Defined cases: a null text counts as an empty one; null hosts and paths are groups of their own;
without labels of both kinds the evidence is nought and the posterior the global rate 0.5;
an empty table gives no rows; repeated rows are judged each; null and conflicting labels: nulls are
left out and a row with both counts as bad; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planisphere.llm.common import map_batches, slices
from planisphere.session import cut

#: Bound of the labelled sample per label.
SAMPLE_ROWS = 8000
SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~"
KEEP_UPPER, KEEP_DIGIT, KEEP_MARK = bytes(range(65, 91)), bytes(range(48, 58)), b"!?"
LETTERS = regex.compile(r"\p{Lu}")


def features(text: str) -> list[float]:
    """Shares that tell prose from repetition, shouting, tables and noise."""
    data = text.encode("utf-8")
    words = data.split()
    n, size = len(words), max(len(data), 1)
    if not n:
        return [0.0] * 14
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = sum(map(bytes.__eq__, words[1:], words)) / n
    pairs = Counter(zip(words, words[1:]))
    upper = len(LETTERS.findall(text)) / max(len(text), 1)
    kept = lambda x: (len(data) - len(data.translate(None, x))) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        math.log1p(n), len(counts) / n, max(counts.values()) / n, repeats,
        (sum(pairs.values()) - len(pairs)) / max(n - 1, 1), lengths.mean(), lengths.std(), upper, kept(KEEP_DIGIT), kept(KEEP_MARK), kept(SYMBOLS),
        counts.get(b"|", 0) / n, 1 - len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)),
    ]


def hinges(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The features and what each exceeds its knots by."""
    parts = [x] + [np.maximum(x - k, 0) for k in knots]
    return np.concatenate(parts, axis=1)


class TextClassifier:
    """Logistic regression on hinge features; ``evidence`` is the log likelihood ratio of good against bad."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.weights = None
        if len(y) == 0 or y.min() == y.max():
            return
        self.knots = np.quantile(x, [0.25, 0.5, 0.75, 0.9, 0.97], axis=0)
        z = hinges(x, self.knots)
        self.mean, self.scale = z.mean(axis=0), z.std(axis=0) + 1e-9
        z = np.concatenate([(z - self.mean) / self.scale, np.ones((len(z), 1))], axis=1)
        w, each = np.zeros(z.shape[1]), np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y == 0).mean())  # both labels weigh the same
        ridge = np.full(z.shape[1], 1.0)
        ridge[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (each * (p - y)) + ridge * w
            h = (z * (each * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def evidence(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        z = (hinges(x, self.knots) - self.mean) / self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -20, 20)


def with_features(rows: DataFrame, other: str) -> DataFrame:
    """Columns of ``rows`` named in the schema ``other``, with ``x`` instead of ``text`` (the last column)."""
    names = [c.split()[0] for c in other.split(", ")]

    def run(batch):
        for part in slices(batch, "text"):
            x = [features(t) for t in part.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + [pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    return map_batches(rows.select(*names, "text"), run, f"{other}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> TextClassifier:
    """Classifier of at most ``sample_rows`` rows of each label, drawn by a seeded hash; only their features reach the driver."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(label_col).alias("y"))
    order = [F.xxhash64(F.lit(seed), "id"), "id"]
    some = known.filter("y = 0").orderBy(*order).limit(sample_rows).union(known.filter("y = 1").orderBy(*order).limit(sample_rows))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(some.select("id", F.col("y").cast("int").alias("y"))), "id")
    # One row per id, of repeated ones the same each time, in one order: the weights are equal in every run.
    coded = with_features(rows.select("id", "y", "text"), "id bigint, y int").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = sorted(coded.collect())  # two labels of ``sample_rows`` rows each
    return TextClassifier(np.array([r.x for r in got]).reshape(-1, 14), np.array([r.y for r in got], float))


def host_of(url: Column) -> Column:
    """Host of a URL without a leading ``www.`` or ``m.``; lower case."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?(?:www\.|m\.)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    """First folder of a URL's path."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]*)/", 1)


def _strength(between: float, within: float, groups: float, rest: float, share: float) -> float:
    """Prior size of a Beta law from sums of squares between and within groups, their degrees of freedom and the usual group size."""
    if groups < 1 or rest < 1:
        return 1e6
    ms_b, ms_w = between / groups, max(within / rest, 1e-9)
    rho = (ms_b - ms_w) / max(ms_b + (share - 1) * ms_w, 1e-12)
    return float(min(max(1 / rho - 1, 2.0), 1e6)) if rho > 1e-6 else 1e6


def posterior(scored: DataFrame, prior: float | None = None, iterations: int = 3) -> DataFrame:
    """From ``doc_id, host, path, evidence``: adds ``host_rate``, ``path_rate`` and ``posterior``.

    Rates use soft counts: a document counts by its probability under the rate before. The rates of a document
    are those of the other documents of its host and path, so that its own evidence counts once. The
    number of iterations is fixed and each reads one row per path.
    """
    rate = 0.5 if prior is None else prior
    key = [F.coalesce("host", F.lit("")), F.col("host").isNull(), F.coalesce("path", F.lit("")), F.col("path").isNull()]
    rows = scored.select("*", key[0].alias("_h"), key[1].alias("_hn"), key[2].alias("_p"), key[3].alias("_pn"))
    for _ in range(iterations if prior is None else 0):
        p = 1 / (1 + F.exp(-(F.col("evidence") + math.log(rate / (1 - rate)))))
        new = rows.agg(F.avg(p)).first()[0]
        if new is None:
            break
        rate = min(max(new, 0.001), 0.999)
    soft = 1 / (1 + F.exp(-(F.col("evidence") + math.log(rate / (1 - rate)))))
    paths = cut(rows.groupBy("_h", "_hn", "_p", "_pn").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(soft).alias("s"), F.sum(soft * soft).alias("q")))
    hosts = paths.groupBy("_h", "_hn").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ps"), F.sum(F.col("n") * F.col("n")).alias("pn2"), F.count(F.lit(1)).alias("k"))
    t = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hq").alias("q"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("b"), F.sum(F.col("hn") * F.col("hn")).alias("n2"),
        F.count(F.lit(1)).alias("k"), F.sum("ps").alias("pb"), F.sum(F.col("pn2") / F.col("hn")).alias("pn2"), F.sum("k").alias("pk"),
    ).first()
    if t.n is None:
        host_size = path_size = 1e6
    else:
        host_size = _strength(t.b - t.s * t.s / t.n, t.q - t.b, t.k - 1, t.n - t.k, (t.n - t.n2 / t.n) / max(t.k - 1, 1))
        # paths within hosts: sums of squares around each host's mean
        path_size = _strength(t.pb - t.b, t.q - t.pb, t.pk - t.k, t.n - t.pk, (t.n - t.pn2) / max(t.pk - t.k, 1))
    sums = paths.join(hosts.select("_h", "_hn", "hs", "hn"), ["_h", "_hn"]).select("_h", "_hn", "_p", "_pn", F.col("s").alias("_s"), F.col("n").alias("_n"), F.col("hs").alias("_hs"), F.col("hn").alias("_hc"))
    joined = rows.join(sums, ["_h", "_hn", "_p", "_pn"]).withColumn("_own", soft)
    host_rate = (F.greatest(F.col("_hs") - F.col("_own"), F.lit(0.0)) + F.lit(host_size * rate)) / (F.col("_hc") - 1 + F.lit(host_size))
    path_rate = (F.greatest(F.col("_s") - F.col("_own"), F.lit(0.0)) + F.lit(path_size) * F.col("host_rate")) / (F.col("_n") - 1 + F.lit(path_size))
    odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    rated = joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return rated.drop("_h", "_hn", "_p", "_pn", "_s", "_n", "_hs", "_hc", "_own")


def evidence(docs: DataFrame, model: TextClassifier, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, host, path, evidence`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        for part in slices(batch, "text"):
            x = np.array([features(t) for t in part.column(3).to_pylist()]).reshape(-1, 14)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(shared.value.evidence(x))], ["doc_id", "host", "path", "evidence"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, run, "doc_id bigint, host string, path string, evidence double")


def judge(docs: DataFrame, model: TextClassifier, host: Column, path: Column, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, host, path, evidence, host_rate, path_rate, posterior, kept`` of every row."""
    return posterior(cut(evidence(docs, model, host, path, id_col, text_col))).withColumn("kept", F.col("posterior") >= threshold)


def keep_good(docs: DataFrame, model: TextClassifier, host: Column, path: Column, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose posterior reaches ``threshold``, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        for part in slices(batch, "text"):
            x = np.array([features(t or "") for t in part.column(1).to_pylist()]).reshape(-1, 14)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.evidence(x))], ["row", "text", "host", "path", "evidence"])

    rest = [c for c in docs.columns if c != text_col]  # the text travels once, beside the other columns
    packed = docs.select(F.struct(*rest).alias("row"), F.col(text_col).cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, text string, host string, path string, evidence double"
    kept = posterior(cut(map_batches(packed, run, schema))).filter(F.col("posterior") >= threshold)
    return kept.select(*[F.col("text" if c == text_col else f"row.{c}").alias(c) for c in docs.columns])
