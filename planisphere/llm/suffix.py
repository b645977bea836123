"""Exact substring deduplication by suffix arrays.

Every byte is removed that a string of ``span`` bytes covers which also starts in a
document with a smaller id. The work is split so that no task needs more than a shard:

1. Documents are dealt into shards. Each run of neighbouring windows of ``span`` bytes
   is named by its anchor, the smallest hashed ``KEY``-byte string in it; equal windows have
   equal anchors at equal places, so only runs whose anchor occurs in several documents can repeat.
   Shards send the hashes of their anchors to buckets by hash and get a bit back for each.
2. Shards send the text of the runs that may repeat to the bucket of their anchor. Runs with
   the same text in one shard go once, for the smallest id.
3. A bucket cuts its runs, ordered by anchor, into blocks of bounded size. Each block
   gets a suffix array by Larsson-Sadakane refinement (numpy sorts of the groups that are still
   open, doubling the compared length) and Kasai's common prefixes; neighbours with a
   common prefix of at least ``span`` bytes are one string, and the smallest id among them decides.
   An anchor whose runs fill several blocks has their sorted strings merged by binary search.
4. The windows found go back to the shards, which cut them out of their texts.

The documents are shuffled once; the three steps that read them share that exchange. Text travels
only for runs whose anchor repeats. A passage in very many documents is sent once per shard.

Defined cases: a null text is empty; documents with a null id, and rows with equal ids, never remove
from one another, and a null id neither removes nor loses anything; an empty table gives
no rows; matches never cross documents; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.llm.common import lean, nullable, parts

KEY = 24
SPAN = 50
BLOCK_BYTES = 1 << 20
RUN_BUCKETS = 4
CHUNK = 1 << 16
LOW = (1 << 17) - 1
END = 0xFF  # never a byte of UTF-8


# ---- suffix arrays ---------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and rank of a byte string, by Larsson-Sadakane refinement.

    The rank of a suffix is the first place of its group; a round sorts only the members of
    open groups by the rank of the suffix ``h`` further on, and doubles ``h``.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable") if n < 8 else np.argsort(key)
    sorted_key = key[order]
    first = np.ones(n, bool)
    first[1:] = sorted_key[1:] != sorted_key[:-1]
    del key, sorted_key
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    h = 8
    if n:
        rank, order, first = _settle_tail(n, order, first, rank)
    while True:
        size = np.diff(np.append(np.flatnonzero(first), n))
        open_ = np.repeat(size > 1, size)
        places = np.flatnonzero(open_)
        if not len(places):
            return order, rank[:n]
        member = order[places]
        old = rank[member]
        beyond = rank[np.minimum(member + h, n)] + 1
        new = np.argsort(old * (n + 2) + beyond)
        member, old, beyond = member[new], old[new], beyond[new]
        order[places] = member
        split = np.ones(len(member), bool)
        split[1:] = (old[1:] != old[:-1]) | (beyond[1:] != beyond[:-1])
        first[places] = split
        rank[member] = places[np.flatnonzero(split)[np.cumsum(split) - 1]]
        h *= 2


def _settle_tail(n, order, first, rank):
    """Zero padding must not make a suffix at the end equal to a longer one."""
    tail = set(range(max(n - 7, 0), n))
    starts = np.flatnonzero(first)
    groups = {int(np.searchsorted(starts, r, "right") - 1) for r in rank[list(tail)]}
    for g in groups:
        lo, hi = int(starts[g]), int(starts[g + 1]) if g + 1 < len(starts) else n
        if hi - lo == 1:
            continue
        short = sorted((i for i in order[lo:hi].tolist() if i in tail), reverse=True)
        rest = [i for i in order[lo:hi].tolist() if i not in tail]
        order[lo:hi] = short + rest
        for k, i in enumerate(short):
            rank[i], first[lo + k] = lo + k, True
        if rest:
            first[lo + len(short)] = True
            rank[rest] = lo + len(short)
    return rank, order, first


def kasai(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, by Kasai's rule.

    The rule walks the text from left to right and begins each comparison one byte short of the last
    one. Here it walks from all ``starts`` at once, one byte of each in a step.
    """
    n = len(text)
    starts = np.zeros(1, np.int64) if starts is None else starts
    ends = np.append(starts[1:], n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    wide = np.concatenate([text.astype(np.int16), np.full(1, -1, np.int16)])
    lcp, at, h = np.zeros(n, np.int32), starts.copy(), np.zeros(len(starts), np.int64)
    live = np.flatnonzero(at < ends)
    while len(live):
        i = at[live]
        j = before[i]
        g = np.maximum(h[live] - 1, 0)
        g[j < 0] = 0
        going = np.flatnonzero(j >= 0)
        while len(going):
            a, b = i[going] + g[going], j[going] + g[going]
            inside = (a < n) & (b < n)
            same = inside & (wide[np.minimum(a, n)] == wide[np.minimum(b, n)])
            going = going[same]
            g[going] += 1
        lcp[i] = g
        h[live] = g
        at[live] += 1
        live = live[at[live] < ends[live]]
    return lcp[order]


def lower_bound(table: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Binary search of rows (words of 8 bytes, big end first) in a sorted table of rows."""
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(table), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        t, q = table[middle], query[open_]
        differs = t != q
        column = np.argmax(differs, axis=1)
        row = np.arange(len(open_))
        less = differs[row, column] & (t[row, column] < q[row, column])
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


# ---- anchors and runs ------------------------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from every position, as one number; ``text`` has eight bytes to spare."""
    return np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))


MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]
MORE = np.uint64(0xBF58476D1CE4E5B9)


def key_hash(words: np.ndarray, at) -> np.ndarray:
    """64-bit hash of the ``KEY`` bytes from each position (an array, or a slice start and stop)."""
    take = (lambda o: words[at[0] + o : at[1] + o]) if isinstance(at, tuple) else (lambda o: words[at + o])
    h = take(0) * MIX[0]
    for o in range(8, KEY, 8):
        h ^= h >> np.uint64(29)
        h += take(o) * MIX[o // 8]
        h *= MORE
    h ^= h >> np.uint64(32)
    return h * MIX[3]


def runs(text: np.ndarray, ends: np.ndarray, span: int):
    """Runs of windows with one anchor: first window, last window, anchor, hash.

    ``text`` holds all documents of a shard, 64 bytes to spare behind; ``ends`` their ends.
    The leftmost smallest hash of a window is its anchor.
    """
    n, words, width = int(ends[-1]) if len(ends) else 0, _words(text), span - KEY + 1
    valid_until = ends - span  # last window of each document
    starts = np.concatenate([[0], ends[:-1]])
    out = []
    for s in range(0, n, CHUNK):
        e = min(s + CHUNK, n)
        # the high bits of the hash, and the place, which makes the leftmost of equal ones the smallest
        h = key_hash(words, (s, e + width - 1)) & ~np.uint64(LOW)
        h |= np.arange(len(h), dtype=np.uint64)
        m, step = h, 1
        while step * 2 <= width:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < width:
            m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
        doc_lo, doc_hi = (int(np.searchsorted(ends, x, "right")) for x in (s, e - 1))
        ok = np.zeros(e - s, bool)
        for k in range(doc_lo, doc_hi + 1):
            a, b = max(int(starts[k]), s), min(int(valid_until[k]) + 1, e)
            if b > a:
                ok[a - s : b - s] = True
        m = np.where(ok, m, ~np.uint64(0))
        change = np.concatenate([[True], m[1:] != m[:-1]])
        first = np.flatnonzero(change)
        last = np.append(first[1:], e - s) - 1
        real = m[first] != ~np.uint64(0)
        first, last = first[real], last[real]
        anchor = (m[first] & np.uint64(LOW)).astype(np.int64)
        out.append((first + s, last + s, anchor + s))
    if not out:
        z = np.empty(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    first, last, anchor = (np.concatenate(x) for x in zip(*out))
    return first, last, anchor, key_hash(words, anchor)


class Shard:
    """Texts of one shard in a fixed order, and the runs of windows in them."""

    def __init__(self, ids, texts):
        rows = [(i, (t or "").encode("utf-8")) for i, t in zip(ids, texts)]
        self.order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
        rows = [rows[k] for k in self.order]
        self.null = sum(i is None for i, _ in rows)
        self.rows = rows
        known = rows[: len(rows) - self.null]
        self.ids = np.array([i for i, _ in known], np.int64)
        self.ends = np.cumsum([len(t) for _, t in known]).astype(np.int64) if known else np.empty(0, np.int64)
        self.text = np.frombuffer(b"".join([t for _, t in known]) + bytes(128), np.uint8)

    def anchors(self, span: int):
        """Distinct hashes in order, with a flag where two documents of the shard have it; and the runs."""
        first, last, anchor, h = runs(self.text, self.ends, span)
        doc = np.searchsorted(self.ends, first, "right")
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], self.ids[doc[order]] if len(doc) else doc
        new = np.ones(len(hs), bool)
        new[1:] = hs[1:] != hs[:-1]
        at = np.flatnonzero(new)
        several = np.minimum.reduceat(ds, at) != np.maximum.reduceat(ds, at) if len(at) else np.empty(0, bool)
        return hs[at], several, (first, last, anchor, h, doc)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _short(h: np.ndarray, flag: np.ndarray) -> bytes:
    """39 bits of each hash and a flag, in 5 bytes."""
    x = (h & np.uint64((1 << 39) - 1)) | (flag.astype(np.uint64) << np.uint64(39))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _long(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :5] = x
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _same_text(words: np.ndarray, a: np.ndarray, b: np.ndarray, first_a, last_a, first_b, last_b, span: int) -> np.ndarray:
    """Whether two runs of equal shape hold the same bytes: their first and last windows cover them."""
    same = (last_a - first_a) == (last_b - first_b)
    for x, y in ((first_a, first_b), (last_a, last_b)):
        for o in (*range(0, span - 8, 8), span - 8):
            same &= words[x + o] == words[y + o]
    return same


def _gather(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    at = np.arange(total, dtype=np.int64) + np.repeat(start - (np.cumsum(length) - length), length)
    return text[at]


def _covered(starts: np.ndarray, n: int, span: int) -> np.ndarray:
    """Which of ``n`` places the windows from these starts (ascending) cover."""
    change = np.zeros(n + 1, np.int8)
    if len(starts):
        apart = np.diff(starts) > span
        change[starts[np.append(True, apart)]] = 1
        change[starts[np.append(apart, True)] + span] -= 1
    return np.cumsum(change[:n], dtype=np.int8) > 0


def pack(columns: list[np.ndarray], text: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(columns[0]), len(text)], "<i8").tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns) + text.tobytes(), 1)


def unpack(data: bytes, kinds: list[str]):
    import zstandard

    raw = zstandard.decompress(data)
    n, size = np.frombuffer(raw, "<i8", 2)
    at, out = 16, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += int(n) * np.dtype(k).itemsize
    return out, np.frombuffer(raw, np.uint8, size, at)


# ---- blocks of runs --------------------------------------------------------------------------------


def smallest_ids(text: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, span: int):
    """For the runs of one block: the windows in the order of the suffix array, their classes and smallest owners.

    Returns (run, offset) of each window, its class, and per class the smallest owner and one window's place.
    """
    joined = np.full(int(length.sum()) + len(length), END, np.uint8)
    begin = np.cumsum(length + 1) - (length + 1)
    inside = np.arange(int(length.sum()), dtype=np.int64) + np.repeat(begin - (np.cumsum(length) - length), length)
    joined[inside] = _gather(text, start, length)
    order, rank = suffix_array(joined)
    lcp = kasai(joined, order, rank, begin)
    run = np.repeat(np.arange(len(length)), length + 1)
    offset = np.arange(len(joined)) - begin[run]
    window = (offset <= length[run] - span)[order]
    # Windows of one class stand together; the smallest common prefix since the window before decides.
    group = np.cumsum(lcp < span)[window]
    place = order[window]
    new = np.ones(len(place), bool)
    new[1:] = group[1:] != group[:-1]
    cls = np.cumsum(new) - 1
    who = owner[run[place]]
    low = np.minimum.reduceat(who, np.flatnonzero(new)) if len(place) else who
    return run[place], offset[place], cls, low, place[new], joined


def _table(joined: np.ndarray, place: np.ndarray, span: int) -> np.ndarray:
    """The strings of ``span`` bytes at some places as rows of big-endian words."""
    wide = -(-span // 8) * 8
    rows = np.zeros((len(place), wide), np.uint8)
    rows[:, :span] = joined[place[:, None] + np.arange(span)]
    return rows.view(">u8").astype(np.uint64)


def decide(text: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray, doc: np.ndarray, span: int, block_bytes: int = BLOCK_BYTES):
    """Bit masks of the windows of each run that also start in a document with a smaller id."""
    n = len(start)
    mask = np.zeros(n, np.uint32)
    if not n:
        return mask
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = _words(padded)
    key = key_hash(words, start + anchor)
    # runs with the same bytes are one, with the smallest id
    look = key ^ (words[start] * MIX[1]) ^ (words[start + length - 8] * MIX[2]) ^ (anchor.astype(np.uint64) << np.uint64(8)) ^ length.astype(np.uint64)
    order = np.lexsort((doc, look, key))
    head = np.ones(n, bool)
    a, b = order[1:], order[:-1]
    head[1:] = ~((key[a] == key[b]) & (look[a] == look[b]) & (anchor[a] == anchor[b]) & _same_text(words, a, b, start[a], start[a] + length[a] - span, start[b], start[b] + length[b] - span, span))
    leader = order[head]  # in the order of the anchors
    size = np.cumsum(length[leader])
    cut = [0]
    while cut[-1] < len(leader):
        base = size[cut[-1] - 1] if cut[-1] else 0
        to = max(int(np.searchsorted(size, base + block_bytes, "right")), cut[-1] + 1)
        if to < len(leader):  # end with the anchor, if it did not fill the block
            back = int(np.searchsorted(key[leader], key[leader[to - 1]])) if key[leader[to]] == key[leader[to - 1]] else to
            to = back if back > cut[-1] else to
        cut.append(to)
    lead_mask = np.zeros(len(leader), np.uint64)
    low_of: list = []
    held: list = []  # blocks of an anchor that goes on

    def settle():
        if len(held) == 1:
            low = [held[0][3]]
        else:  # merge the sorted strings of the blocks by binary search
            tables = [_table(h[5], h[4], span) for h in held]
            low = [h[3].copy() for h in held]
            for x in range(len(held)):
                for y in range(len(held)):
                    if x != y:
                        at = np.minimum(lower_bound(tables[y], tables[x]), len(tables[y]) - 1)
                        same = (tables[y][at] == tables[x]).all(axis=1)
                        low[x] = np.where(same, np.minimum(low[x], held[y][3][at]), low[x])
        for (run, offset, cls, _, _, _, base), best in zip(held, low):
            low_of.append((run + base, offset, best[cls]))
        held.clear()

    for s, e in zip(cut[:-1], cut[1:]):
        some = leader[s:e]
        if held and key[leader[s]] != key[leader[s - 1]]:
            settle()
        held.append((*smallest_ids(text, start[some], length[some], doc[some], span), s))
        if e == len(leader) or key[leader[e]] != key[leader[e - 1]]:
            settle()
            for run, offset, low in low_of:
                hit = low < doc[leader[run]]
                np.bitwise_or.at(lead_mask, run[hit], np.uint64(1) << offset[hit].astype(np.uint64))
            low_of.clear()
    which = np.cumsum(head) - 1
    full = (np.uint64(1) << (length - span + 1).astype(np.uint64)) - np.uint64(1)
    mask[order] = np.where(doc[order] > doc[leader[which]], full[order], lead_mask[which]).astype(np.uint32)
    return mask


# ---- Spark -----------------------------------------------------------------------------------------


def deduplicate(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans (array of [start, stop)), kept (binary)`` of every row, and a struct ``carried`` of the columns named in ``carry``.

    With ``as_text``, ``kept`` is a string; what a cut leaves of a letter of several bytes goes too.
    """
    if not KEY + 8 <= span <= KEY + 31:
        raise ValueError(f"a span from {KEY + 8} to {KEY + 31} bytes is supported")
    spark = docs.sparkSession
    count = shards or parts(spark)
    slots = RUN_BUCKETS * count  # the runs that repeat, with their text, go to smaller buckets than the anchors
    shard = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(count)).cast("int")
    also = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []  # without the text, which travels anyway
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *also)
    dealt = base.select("*", shard.alias("shard")).repartition(count, "shard")

    def load(t: pa.Table) -> Shard:
        return Shard(t.column("doc_id").to_pylist(), t.column("text").to_pylist())

    def one_shard(t: pa.Table) -> int:
        return t.column("shard")[0].as_py()

    def send_anchors(t: pa.Table) -> pa.Table:
        h, several, _ = load(t).anchors(span)
        b = _bucket(h, count)
        order = np.argsort(b, kind="stable")
        edges = np.searchsorted(b[order], np.arange(count + 1))
        rows = [(k, _short(h[order[s:e]], several[order[s:e]])) for k, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
        return pa.table({"bucket": pa.array([k for k, _ in rows], pa.int32()), "shard": pa.array([one_shard(t)] * len(rows), pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})

    anchors = dealt.groupBy("shard").applyInArrow(lean(send_anchors), "bucket int, shard int, data binary")

    def shared_bits(t: pa.Table) -> pa.Table:
        lists = [_long(d) for d in t.column("data").to_pylist()]
        every = np.concatenate(lists)
        flag, h = every >> np.uint64(39) > 0, every & np.uint64((1 << 39) - 1)
        order = np.argsort(h, kind="stable")
        hs = h[order]
        new = np.ones(len(hs), bool)
        new[1:] = hs[1:] != hs[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(hs)))
        hit = (size > 1) | np.logical_or.reduceat(flag[order], at)
        bits = np.empty(len(hs), bool)
        bits[order] = np.repeat(hit, size)
        ends = np.cumsum([len(x) for x in lists])
        return pa.table({"shard": t.column("shard").cast(pa.int32()), "bucket": t.column("bucket").cast(pa.int32()), "data": pa.array([np.packbits(x).tobytes() for x in np.split(bits, ends[:-1])], pa.binary())})

    bits = anchors.groupBy("bucket").applyInArrow(lean(shared_bits), "shard int, bucket int, data binary")

    def send_runs(t: pa.Table, answer: pa.Table) -> pa.Table:
        empty = {"bucket": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "data": pa.array([], pa.binary())}
        if not t.num_rows or not answer.num_rows:
            return pa.table(empty)
        me, own = load(t), one_shard(t)
        h, _, (first, last, anchor, run_hash, doc) = me.anchors(span)
        b = _bucket(h, count)
        shared = np.zeros(len(h), bool)
        order = np.argsort(b, kind="stable")
        edges = np.searchsorted(b[order], np.arange(count + 1))
        for k, data in zip(answer.column("bucket").to_pylist(), answer.column("data").to_pylist()):
            some = order[edges[k] : edges[k + 1]]
            shared[some] = np.unpackbits(np.frombuffer(data, np.uint8), count=len(some)).astype(bool)
        take = shared[np.searchsorted(h, run_hash)]
        first, last, anchor, run_hash, doc = (x[take] for x in (first, last, anchor, run_hash, doc))
        ids = me.ids[doc]
        # equal runs of this shard: the smallest id is sent, the others lose all of the run's windows
        words = _words(me.text)
        look = run_hash ^ (words[first] * MIX[1]) ^ (words[last + span - 8] * MIX[2]) ^ ((anchor - first).astype(np.uint64) << np.uint64(8)) ^ (last - first).astype(np.uint64)
        order = np.lexsort((first, ids, look, run_hash))
        head = np.ones(len(order), bool)
        x, y = order[1:], order[:-1]
        head[1:] = ~((look[x] == look[y]) & (anchor[x] - first[x] == anchor[y] - first[y]) & _same_text(words, x, y, first[x], last[x], first[y], last[y], span))
        lead = order[head][np.cumsum(head) - 1]
        later = np.zeros(len(order), bool)
        later[order] = ids[order] > ids[lead]
        rows = []
        if later.any():
            width = (last - first + 1)[later].astype(np.uint64)
            rows.append((own, 1, pack([first[later], ((np.uint64(1) << width) - np.uint64(1)).astype("<u4")], np.empty(0, np.uint8))))
        stay = np.flatnonzero(~later)
        b = _bucket(run_hash[stay], slots)
        order = np.argsort(b, kind="stable")
        stay, b = stay[order], b[order]
        edges = np.searchsorted(b, np.arange(slots + 1))
        for k in range(slots):
            some = np.sort(stay[edges[k] : edges[k + 1]])
            if len(some):
                length = last[some] - first[some] + span
                docs_here, local = np.unique(doc[some], return_inverse=True)
                columns = [first[some].astype("<i8"), length.astype("<u2"), (anchor[some] - first[some]).astype("<u2"), me.ids[docs_here][local].astype("<i8")]
                rows.append((k, 0, pack(columns, _gather(me.text, first[some], length))))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([own] * len(rows), pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})

    sent = dealt.groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(lean(send_runs), "bucket int, shard int, kind int, data binary")

    def find(t: pa.Table) -> pa.Table:
        shard, kind, data = (t.column(c).to_pylist() for c in ("shard", "kind", "data"))
        rows = [(s, d) for s, k, d in zip(shard, kind, data) if k == 1]
        mine = [(s, unpack(d, ["<i8", "<u2", "<u2", "<i8"])) for s, k, d in zip(shard, kind, data) if k == 0]
        if mine:
            text = np.concatenate([x[1] for _, x in mine])
            first, length, anchor, doc = (np.concatenate([x[0][i] for _, x in mine]).astype(np.int64) for i in range(4))
            start = np.cumsum(length) - length
            mask = decide(text, start, length, anchor, doc, span, block_bytes)
            at = 0
            for s, (columns, _) in mine:
                m = mask[at : at + len(columns[0])]
                if m.any():
                    rows.append((s, pack([first[at : at + len(m)][m > 0], m[m > 0].astype("<u4")], np.empty(0, np.uint8))))
                at += len(columns[0])
        return pa.table({"shard": pa.array([s for s, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})

    found = sent.groupBy("bucket").applyInArrow(lean(find), "shard int, data binary")

    def cut_out(t: pa.Table, windows: pa.Table):
        me = load(t)
        n = int(me.ends[-1]) if len(me.ends) else 0
        begins = np.zeros(n + 1, bool)
        for data in windows.column("data").to_pylist() if windows.num_rows else []:
            (first, mask), _ = unpack(data, ["<i8", "<u4"])
            for k in range(span - KEY + 1):
                begins[first[(mask >> np.uint32(k)) & np.uint32(1) > 0] + k] = True
        gone = _covered(np.flatnonzero(begins), n, span)
        ids, sizes, removed, spans, kept = [], [], [], [], []
        starts = np.concatenate([[0], me.ends[:-1]]).astype(np.int64) if len(me.ends) else me.ends
        for k, (i, raw) in enumerate(me.rows):
            out = gone[starts[k] : me.ends[k]] if k < len(me.ends) else np.zeros(len(raw), bool)
            ids.append(i), sizes.append(len(raw)), removed.append(int(out.sum()))
            if removed[-1]:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                spans.append(edge.reshape(-1, 2).tolist())
                kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
            else:
                spans.append([]), kept.append(raw)
        rest = {"carried": t.column("carried").cast(nullable(t.schema.field("carried").type)).take(pa.array(me.order, pa.int64()))} if carry else {}
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())} | rest)

    more = f", carried {dealt.schema['carried'].dataType.simpleString()}" if carry else ""
    return dealt.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(lean(cut_out), f"doc_id bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept {'string' if as_text else 'binary'}" + more)


def keep_new(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with repeated text cut out, and the columns they came with; rows that repeat as a whole go.

    A column ``n_chars`` is counted anew where text was cut; a null text stays null.
    """
    marked = docs.withColumn("_null_text", F.col(text_col).isNull())
    carry = [c for c in marked.columns if c != text_col]
    done = deduplicate(marked, span, id_col, text_col, carry=carry, as_text=True).filter("n_removed = 0 OR n_removed < n_bytes")
    columns = {c: F.col(f"carried.{c}") for c in docs.columns if c != text_col}
    columns[text_col] = F.when(~F.col("carried._null_text"), F.col("kept"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*[columns[c].alias(c) for c in docs.columns])


def brute_force(rows, span: int = SPAN) -> dict:
    """The same by a dictionary of strings: (id, text) -> id: (kept, removed, spans); for tests."""
    low: dict[bytes, int] = {}
    data = [(i, (t or "").encode("utf-8")) for i, t in rows]
    for i, raw in data:
        for p in range(len(raw) - span + 1):
            w = raw[p : p + span]
            low[w] = min(low.get(w, i), i)
    out = {}
    for i, raw in data:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - span + 1):
            if low[raw[p : p + span]] < i:
                gone[p : p + span] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(np.int8)))
        kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        out[i] = len(raw), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest()
    return out
