"""Toxicity by a support vector machine on a gapped-subsequence string kernel.

The kernel of two strings sums over all letter triples u that both contain, in order but
with any gaps, the product of ``decay ** span`` of their occurrences, and is normalised.
Inserted or repeated letters and separators lengthen spans and lower it gently, so
``s.t.u-p.i.d`` stays near the word it hides.

Training uses a bounded sample of labelled documents. Their labels hold for a whole document, so the
machine learns from many instances (:class:`Machine`): the worst windows of the toxic documents, chosen
anew in every round, against windows of the clean ones, with gapped and disturbed variants of the commonest.
Nyström landmarks are such windows and the hardest clean ones; a linear machine is trained
on the landmark features. As the decision is linear in the triples, it is folded into one
weight per triple, and a window is scored by a weighted look-up of its own triples.

A window is a white-space-free token without outer punctuation, or a run of single
letters; a token with separators inside is read without them as well. Tokens above ``WINDOW`` letters are cut into overlapping windows that cover them
whole. A document scores by its worst tokens: one beyond a strict cut, or the three worst together, both fitted
on labelled documents that the judging machine has not seen (:class:`ToxicModel`).

Defined cases: null and empty texts score as a document without windows does; null or
conflicting labels (a document with both counts as toxic) and labels without document do not fail; without a
toxic or a clean training row every score is the share of toxic rows (0.5 without any
row); repeated rows score each; other columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.llm.common import map_batches, slices
from planisphere.session import cut

#: Bounds of the training sample: rows of each label, and characters of the longest text drawn into it.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 16_000
#: Letters told apart by the kernel, the commonest of the sample; all others are one more.
LETTERS = 123
WINDOW, STEP = 20, 10
CACHE_WORDS = 400_000
EDGE = ".,;:!?\"'()[]{}<>|*-_#$%&/\\~`^+="
#: Four or more single letters with white space between them.
SPELLED = regex.compile(r"(?<!\S)(?:\w\s+){3,}\w(?!\S)")
LANDMARKS, ROUNDS, COST = 600, 8, 10.0
#: Windows that a toxic document brings, and different ones that train.
PICKED, POSITIVES = 3, 800
#: Weight of a share of false alarms beside the same share of toxic documents missed: clean ones are the rule.
ALARM = 10.0
FIRST, LAST = "\x02", "\x03"


class SubsequenceKernel:
    def __init__(self, letters: str, decay: float = 0.8):
        self.decay = decay
        self.letter = {c: i + 3 for i, c in enumerate(letters)}  # 0 digits, 1 other letters, 2 the rest
        self.size = len(letters) + 3
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def codes(self, word: str) -> list[int]:
        get = self.letter.get
        return [get(c, -1) if c in self.letter else (0 if c.isdigit() else 1 if c.isalpha() else 2) for c in word]

    def triples(self, words: list[str]):
        """(positions in ``words``, triple codes, weights) per length and chunk; shorter words than three letters have none."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= 3:
                by.setdefault(len(w), []).append(i)
        for n, rows in by.items():
            if n not in self.places:
                p = np.array(list(combinations(range(n), 3)))
                self.places[n] = p, (self.decay ** (p[:, 2] - p[:, 0] + 1.0)).astype(np.float32)
            p, weight = self.places[n]
            step = max(1, 2_000_000 // len(p))
            for s in range(0, len(rows), step):
                some = rows[s : s + step]
                x = np.array([self.codes(words[i]) for i in some], np.int32)
                yield np.array(some), (x[:, p[:, 0]] * self.size + x[:, p[:, 1]]) * self.size + x[:, p[:, 2]], weight

    @staticmethod
    def norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Length of the feature vector of each row."""
        order = np.argsort(code, axis=1)
        sorted_code = np.take_along_axis(code, order, axis=1)
        w = weight[order].ravel()
        new = np.ones(code.shape, bool)
        new[:, 1:] = sorted_code[:, 1:] != sorted_code[:, :-1]
        at = np.flatnonzero(new.ravel())
        sums = np.add.reduceat(w, at)
        return np.sqrt(np.bincount(at // code.shape[1], sums.astype(np.float64) ** 2, minlength=len(code)))

    def dense(self, words: list[str]):
        """Normalised features, one column per word, and the row of each triple that occurs (-1: none)."""
        found = [(rows, code, weight[None, :] / self.norms(code, weight)[:, None]) for rows, code, weight in self.triples(words)]
        codes = np.unique(np.concatenate([code.ravel() for _, code, _ in found])) if found else np.empty(0, np.int64)
        row = np.full(self.size**3, -1, np.int32)
        row[codes] = np.arange(len(codes))
        out = np.zeros((len(codes), len(words)), np.float32)
        for rows, code, scaled in found:
            np.add.at(out, (row[code], rows[:, None]), scaled)
        return out, row

    def against(self, words: list[str], columns) -> np.ndarray:
        """Kernel of each word with each column of :meth:`dense`."""
        dense, row = columns
        out = np.zeros((len(words), dense.shape[1]))
        for rows, code, weight in self.triples(words):
            norm = self.norms(code, weight)
            for s in range(0, len(rows), 64):
                some = row[code[s : s + 64]]
                i, j = np.nonzero(some >= 0)
                if len(i):
                    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                    sums = np.add.reduceat(dense[some[i, j]] * weight[j, None], first, axis=0)
                    out[rows[s + i[first]]] = sums / norm[s + i[first], None]
        return out


def windows(token: str) -> list[str]:
    """The token between marks of its start and end; without its separators as well if it holds any."""
    word = token.strip(EDGE)
    out = []
    for w in [word] if word.isalnum() else [word, "".join(filter(str.isalnum, word))]:
        w = FIRST + w + LAST
        out += [w] if len(w) <= WINDOW else [w[s : s + WINDOW] for s in range(0, len(w) - WINDOW + STEP, STEP)]
    return out


def tokens(text: str) -> list[str]:
    """Windows before cutting: lower-cased tokens and joined runs of single letters."""
    low = text.lower()
    return low.split() + ["".join(m.group().split()) for m in SPELLED.finditer(low)]


def disturbed(window: str, rng) -> list[str]:
    """Variants with inserted, doubled and replaced letters; separators are read without as well."""
    word = window[1:-1]
    out = []
    if len(word) > 3:
        for _ in range(3):
            i = int(rng.integers(1, len(word)))
            out.append(word[:i] + word[i - 1] + word[i:])
            out.append(word[:i] + str(rng.choice(list(".-_*x1"))) + word[i:])
    if len(word) > 4:
        for i in rng.permutation(len(word))[:4].tolist():
            out.append(word[:i] + str(rng.choice(list("013457*@$!"))) + word[i + 1 :])
    return [FIRST + w + LAST for w in out]


def linear_machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights (the last for a constant) of a linear support vector machine with squared hinge loss; Newton steps on its margin violators."""
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    loss = lambda v: 0.5 * v @ ridge @ v + cost @ np.maximum(1 - y * (z @ v), 0) ** 2
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        active = y * (z @ w) < 1
        za, ca = z[active], cost[active]
        target = np.linalg.solve(ridge + 2 * (za * ca[:, None]).T @ za, 2 * za.T @ (ca * y[active]))
        step, now = 1.0, loss(w)
        while step > 1e-4 and loss(w + step * (target - w)) > now:
            step /= 2
        new = w + step * (target - w)
        done = np.abs(new - w).max() < 1e-7
        w = new
        if done:
            break
    return w


def near_key(words: set[str]) -> tuple[int, ...]:
    """The same for near copies: their three smallest word hashes."""
    return tuple(sorted(zlib.crc32(w.encode()) for w in words)[:3])


class Machine:
    """Kernel machine on the windows of labelled documents, folded into one weight per triple and a constant.

    Multiple instances: only a document's label is known, so each toxic one brings its ``PICKED`` windows that look
    worst, first by the odds of the labels and then, round by round, by the machine itself. Windows that fewer than
    ``least`` toxic documents bring say nothing of other documents and are left out. Of the clean documents the
    commonest windows and a random part train from the start, and those that score highest join in every round.
    """

    def __init__(self, bad: list[list[str]], good: list[list[str]], seed: int = 42):
        rng = np.random.default_rng(seed)
        bags = list({near_key(set(s)): s for s in bad}.values())
        inside, outside = Counter(w for s in bags for w in s), Counter(w for s in good for w in s)
        odds = {w: math.log((n + 0.5) * (len(good) + 1) / ((outside[w] + 0.5) * (len(bags) + 1))) for w, n in inside.items() if sum(map(str.isalpha, w)) >= 3}
        # Words known to be ten times as usual in toxic documents; the machine never reads which.
        bags = [[w for w in s if odds.get(w, 0) > math.log(10)] for s in bags]
        least = 2 + (len(bags) > 50)
        chosen = self.pick(bags, odds, least)
        self.positives: list[str] = []
        self.hard: list[str] = []
        if not chosen:
            return
        common = Counter(c for s in good + bad for w in s for c in w if c.isalpha())
        self.kernel = SubsequenceKernel(FIRST + LAST + "".join(sorted(c for c, _ in common.most_common(LETTERS))))
        usual = sorted(w for w in outside if len(w) >= 4)
        often = [w for w, _ in outside.most_common(1000) if len(w) >= 3]
        clean = sorted({*often, *(usual[i] for i in rng.choice(len(usual), min(1500, len(usual)), replace=False))}) if usual else [FIRST + "  " + LAST]
        own = sorted({w for s in bags for w in s})
        for _ in range(ROUNDS):
            lead = sorted(chosen, key=lambda w: (-chosen[w], w))[:POSITIVES]
            variants = [v for w in lead[: POSITIVES // 8] for v in disturbed(w, rng)]
            self.positives = lead + variants
            taken = set(lead)
            negatives = [w for w in sorted({*clean, *self.hard}) if w not in taken]
            marks = list(dict.fromkeys([*lead[: LANDMARKS // 2], *self.hard, *negatives]))[:LANDMARKS]
            self.solve(marks, negatives, np.array([COST * min(chosen[w], 3) for w in lead] + [COST] * len(variants) + [3 * COST * min(max(outside[w], 1), 3) for w in negatives]))
            score = self.windows_score(usual)
            known = {*self.positives, *negatives}
            new = [usual[i] for i in np.argsort(-score)[:600] if score[i] > -0.5 and usual[i] not in known][:150]
            again = self.pick(bags, dict(zip(own, self.windows_score(own).tolist())), least) or chosen
            if not new and again.keys() == chosen.keys():
                break
            self.hard, chosen = new + self.hard, again

    @staticmethod
    def pick(bags: list[list[str]], value: dict[str, float], least: int) -> Counter:
        """The worst windows of every toxic document and how many documents bring each."""
        got = Counter(w for s in bags for w in sorted(s, key=lambda w: (-value[w], w))[:PICKED])
        return Counter({w: n for w, n in got.items() if n >= min(least, max(got.values()))})

    def solve(self, marks: list[str], negatives: list[str], cost: np.ndarray) -> None:
        columns = self.kernel.dense(marks)
        size, axis = np.linalg.eigh(self.kernel.against(marks, columns) + 1e-6 * np.eye(len(marks)))
        strong = size > 1e-3 * size.max()  # directions in which the landmarks hardly differ are left out
        root = axis[:, strong] / np.sqrt(size[strong])
        y = np.where(np.arange(len(self.positives) + len(negatives)) < len(self.positives), 1.0, -1.0)
        w = linear_machine(self.kernel.against(self.positives + negatives, columns) @ root, y, cost)
        self.weight, self.constant = np.zeros(self.kernel.size**3, np.float32), float(w[-1])
        used = columns[1] >= 0
        self.weight[used] = (columns[0] @ (root @ w[:-1]))[columns[1][used]]

    def windows_score(self, words: list[str]) -> np.ndarray:
        """Decision per window; windows without any toxic triple, or with fewer than three letters, get the constant."""
        out = np.full(len(words), self.constant)
        for rows, code, weight in self.kernel.triples([w if sum(map(str.isalpha, w)) >= 3 else "" for w in words]):
            total = self.weight[code] @ weight
            some = np.flatnonzero(total > 0)
            if len(some):
                out[rows[some]] = total[some] / self.kernel.norms(code[some], weight) + self.constant
        return out

    def fill(self, cache: dict, words) -> None:
        """Decision per token: that of its worst window."""
        new = [w for w in words if w not in cache]
        cut = [windows(w) for w in new]
        score = self.windows_score([x for c in cut for x in c])
        at = 0
        for w, c in zip(new, cut):
            cache[w] = float(score[at : at + len(c)].max())
            at += len(c)

    def evidence(self, texts: list[str], cache: dict) -> np.ndarray:
        """Per text its three worst different tokens: 0 where nothing is toxic, 1 on the margin of the toxic side."""
        if len(cache) > CACHE_WORDS:
            cache.clear()
        split = [set(tokens(t)) for t in texts]
        self.fill(cache, set().union(*split) if split else ())
        out = np.full((len(texts), 3), self.constant)
        for i, s in enumerate(split):
            worst = nlargest(3, map(cache.__getitem__, s))
            out[i, : len(worst)] = worst
        return self.scaled(out)

    def scaled(self, score: np.ndarray) -> np.ndarray:
        return np.maximum(score - self.constant, 0) / max(1 - self.constant, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights (the last for a constant) of a logistic machine, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def boundary(value: np.ndarray, y: np.ndarray, alarm: float) -> tuple[float, float]:
    """Ends of the range of cuts that part both labels best, where a share of false alarms counts ``alarm`` times; all are above zero."""
    edges = np.unique(np.concatenate([value[value > 0], [0.0, value.max() + 1.0]]))
    middle = (edges[1:] + edges[:-1]) / 2
    bad, good = np.sort(value[y]), np.sort(value[~y])
    share = lambda v: 1 - np.searchsorted(v, middle) / max(len(v), 1)
    right = share(bad) - alarm * share(good)
    best = middle[right >= right.max() - 0.003]
    return float(best.min()), float(best.max())


class ToxicModel:
    """The machine, and how the worst tokens of a document become its score.

    One token beyond a strict cut is enough; else the three worst together decide, so several weaker
    signs count as well. Both are fitted on documents that the machine in question was not trained on: the sample is
    halved, near copies together, and each half is judged by a machine of the other.
    """

    def __init__(self, texts: list[str], toxic: list[int], seed: int = 42):
        self.share = float(np.mean(toxic)) if len(toxic) else 0.5
        self.machine = None
        split = [sorted({w for t in set(tokens(x)) for w in windows(t)}) for x in texts]  # sorted: no rerun may differ
        y = np.array(toxic, bool)
        train = lambda rows: Machine([split[i] for i in rows if y[i]], [split[i] for i in rows if not y[i]], seed)
        if not len(y) or y.all() or not y.any():
            return
        whole = train(range(len(y)))
        if not whole.positives:
            return
        self.machine = whole
        half = np.array([zlib.crc32(repr(near_key(set(s))).encode()) % 2 for s in split])
        seen = np.empty((len(y), 3))
        for side in (0, 1):
            rows, others = np.flatnonzero(half == side), np.flatnonzero(half != side)
            judge = train(others.tolist()) if y[others].any() and not y[others].all() else whole
            judge = judge if judge.positives else whole
            if len(rows):
                seen[rows] = judge.evidence([texts[i] for i in rows], {})
        low, high = boundary(seen[:, 0], y, ALARM)
        upper = min(high, max(float(np.quantile(whole.scaled(whole.windows_score(whole.positives)), 0.1)), low))
        self.cut = max((low + upper) / 2, 1e-3)
        self.joint = logistic(seen, y.astype(float))
        low, high = boundary(self.together(seen) - self.joint[-1], y, ALARM)
        self.joint[-1] = -max((low + high) / 2, 1e-3)
        self.steep = 4.0

    def together(self, seen: np.ndarray) -> np.ndarray:
        return seen @ self.joint[:-1] + self.joint[-1]

    def scores(self, texts: list[str], cache: dict) -> list[float]:
        if self.machine is None:
            return [self.share] * len(texts)
        if not texts:
            return []
        seen = self.machine.evidence(texts, cache)
        # At either cut the score is 0.7.
        value = np.maximum(4.0 * self.steep * (seen[:, 0] - self.cut), np.clip(self.together(seen), -30, 30)) + math.log(0.7 / 0.3)
        return (1 / (1 + np.exp(-value))).tolist()


_CACHES: dict[str, dict] = {}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, seed: int = 42) -> ToxicModel:
    """Model of a bounded sample: in the order of a seeded hash of the id, ``sample_rows`` rows of each label.

    Drawn are texts of at most ``sample_chars`` characters, as a label of a long text says little about any of its words; texts of
    every length are scored whole. Of repeated ids the longest text counts, of equally long ones the last.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    fits = rows.select("_id", F.length("_text").alias("_n")).filter(F.col("_n").between(1, sample_chars)).join(known, "_id").groupBy("_id", "_y").agg(F.max("_n").alias("_n"))
    order = [F.xxhash64(F.lit(seed), "_id"), "_id"]
    fits = cut(fits)
    texts, y = [], []
    for label in (0, 1):
        ids = fits.filter(F.col("_y") == label).orderBy(*order).limit(sample_rows).select("_id", "_n")
        some = rows.join(F.broadcast(ids), "_id").filter(F.length("_text") == F.col("_n")).groupBy("_id").agg(F.max("_text").alias("_text"))
        got = some.orderBy(*order).collect()
        texts += [r["_text"] for r in got]
        y += [label] * len(got)
    return ToxicModel(texts, y, seed)


def toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = str(shared._jbroadcast.id()) if shared._jbroadcast is not None else ""

    def run(batch):
        if key not in _CACHES:
            _CACHES.clear()
            _CACHES[key] = {}
        for part in slices(batch, "text"):
            score = shared.value.scores(part.column(1).to_pylist(), _CACHES[key])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, run, "doc_id bigint, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
