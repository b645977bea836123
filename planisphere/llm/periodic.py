"""Detection of periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal) that is at least ``least`` words and ``repeats`` times q long and that no
neighbouring word extends. Many texts are searched at once, as one sequence of
word numbers in which a number of its own stands between two texts.

* Periods below ``SHORT`` come from direct scans: where the sequence equals itself
  q words on, for every such lag q.
* Scale w = 8, 16, 32 ... finds the periods from w to 2w - 1. The hash of the 2w words
  from a position is put together from two hashes of half the length. Every window of w
  positions marks the least hash in it, leftmost first. Inside a run of period q >= w
  the marks repeat q words on, and as 2w > q words cannot recur sooner inside such a
  run, the next mark with the same hash stands exactly q words on. So every run of four
  periods holds a pair of equal neighbouring marks whose distance is its period; each such
  pair is extended word by word, which also throws out any collision of hashes.

The smallest period of a stretch of at least two periods divides every other such
period, so a stretch is given up if it also has the period q / r for a prime r.

Defined cases: a null text is an empty one and has no words and no runs; null ids and
repeated rows are searched each; an empty table gives an empty result; other columns
do not matter. A text is never split, the work grows with its words times the
logarithm of its longest period.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.llm.common import map_batches, slices

SHORT = 8
#: Odd multipliers of the hashes; any would do, as every find is checked word by word.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * MIX[0] + (b ^ (b >> np.uint64(29))) * MIX[1]
    return h ^ (h >> np.uint64(32))


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Least value of every window of ``w``: prefixes and suffixes of blocks meet in each window."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def marks(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the leftmost least hash of some window of ``w``."""
    bits = np.uint64(len(hashes).bit_length())
    packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    least = window_minima(packed, w)
    changed = np.concatenate(([True], least[1:] != least[:-1]))
    return (least[changed] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def matched(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The largest stretch around ``at`` whose words equal those ``lag`` before, where ``at`` and ``at + lag`` do."""
    end, step = at, 64
    while end + lag < len(words):
        differ = np.flatnonzero(words[end : end + step][: len(words) - lag - end] != words[end + lag : end + lag + step])
        if len(differ):
            end += int(differ[0])
            break
        end, step = min(end + step, len(words) - lag), step * 2
    start, step = at, 64
    while start > 0:
        low = max(start - step, 0)
        differ = np.flatnonzero(words[low:start] != words[low + lag : start + lag])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, step * 2
    return start, end + lag


def primes_of(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + ([n] if n > 1 else [])


def smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Whether the first ``period`` words are no repetition of fewer."""
    block = words[start : start + period]
    return not any(np.array_equal(block[period // r :], block[: period - period // r]) for r in primes_of(period))


def find_runs(words: np.ndarray, longest: int, least: int = 6, repeats: int = 4) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; ``longest``: words of the longest text inside."""
    found = []
    top = longest // repeats
    for lag in range(1, min(SHORT - 1, top) + 1):
        wanted = max(least, repeats * lag)
        breaks = np.concatenate(([-1], np.flatnonzero(words[:-lag] != words[lag:]), [len(words) - lag]))
        for k in np.flatnonzero(np.diff(breaks) - 1 + lag >= wanted).tolist():
            start = int(breaks[k]) + 1
            if smallest(words, start, lag):
                found.append((start, int(breaks[k + 1]) - start + lag, lag))
    w = SHORT
    hashes = mixed(words.astype(np.uint64), words.astype(np.uint64))
    size = 1
    while w <= top:
        while size < 2 * w:
            hashes = mixed(hashes[:-size], hashes[size:])
            size *= 2
        at = marks(hashes, w)
        at = at[np.argsort(hashes[at], kind="stable")]
        gap = np.diff(at)
        pairs = (hashes[at[1:]] == hashes[at[:-1]]) & (gap >= w) & (gap < 2 * w) & (gap <= top)
        done: dict[int, int] = {}  # lag -> end of its last stretch
        seeds, lags = at[:-1][pairs], gap[pairs]
        for k in np.argsort(seeds, kind="stable").tolist():
            start, lag = int(seeds[k]), int(lags[k])
            if start + lag < done.get(lag, 0) or words[start] != words[start + lag]:
                continue
            begin, end = matched(words, start, lag)
            done[lag] = end
            if end - begin >= max(least, repeats * lag) and smallest(words, begin, lag):
                found.append((begin, end - begin, lag))
        w *= 2
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False where a word lies in some run behind the run's first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = 6, repeats: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` as array of (start, length, period), and ``collapsed``: the words left, joined by a space."""

    def run(batch):
        for part in slices(batch, "text", 2 << 20):
            texts = [t.split() for t in part.column(1).cast(pa.binary()).to_pylist()]  # of bytes: at ASCII white space
            lengths = np.array([len(t) for t in texts], np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths + 1)))
            flat = [word for t in texts for word in t]
            numbers = np.empty(starts[-1], np.int64)
            ends = starts[1:] - 1
            inside = np.ones(len(numbers), bool)
            inside[ends] = False
            numbers[ends] = -1 - np.arange(len(texts))  # between texts a number that never recurs
            if flat:
                numbers[inside] = pd.factorize(np.array(flat, dtype=object))[0]
            found = find_runs(numbers, int(lengths.max()), least, repeats)
            kept = kept_words(len(numbers), found)
            of = np.searchsorted(starts, found[:, 0], "right") - 1
            whole = np.ones(len(texts), bool)
            whole[of] = False
            collapsed = [b" ".join(t) if whole[k] else b" ".join(word for word, keep in zip(t, kept[starts[k] : ends[k]]) if keep) for k, t in enumerate(texts)]
            bounds = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
            items = pa.StructArray.from_arrays([pa.array(found[:, 0] - starts[of]), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"])
            columns = [part.column(0), pa.array(lengths), pa.ListArray.from_arrays(bounds, items), pa.array(collapsed, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
