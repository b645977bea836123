"""Best-fit packing of documents into sequences by bin completion.

Every document becomes its token ids and an end id; only documents beyond the
capacity are cut, into full pieces behind a shorter first one. How full a sequence
is depends on lengths alone, so the plan is made from the number of pieces of each
length: ``capacity`` counts, whatever the corpus holds.

The plan is a branch-and-bound over completed sequences. Each step takes the
largest length left, enumerates the undominated fillings of the space beside it
(none in which pieces could give way to a longer one left over) and takes one of
them as often as the counts allow. A branch ends when the sequences used and the
bound of what is left (Martello and Toth) reach the incumbent, or when a filling
wastes more than a better packing may waste in all. Best fit of what is left
completes every ``every``-th node and keeps the better packing as the incumbent; the
search ends when the incumbent meets the bound, or after ``nodes`` nodes.

Spark numbers the pieces by length with a range sort; a piece's number says which
step of the plan, and which sequence of that step, it belongs to. No task holds
more than its partition, however many pieces share one length.

Defined cases: a null text is an empty one; an empty document is the end id alone;
null ids and repeated rows are packed like others; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import json
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.llm.bpe import _File, byte_letters
from planisphere.llm.common import map_batches, slices
from planisphere.operators.subset import assign_ids
from planisphere.session import cut

#: Fixed value: how the byte-level pre-tokenizer splits a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# ---- tokens and pieces


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library whose ids follow its merges."""

    def __init__(self, content: bytes):
        import tiktoken

        spec = json.loads(content)
        model, split = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-level file")
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        for i, merge in enumerate(model["merges"]):
            if model["vocab"]["".join(merge.split(" ") if isinstance(merge, str) else merge)] != 256 + i:
                raise ValueError("the ids of the file do not follow its merges")
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items()}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.coder = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, allowed_special="all")


_MODELS: dict[int, ByteBpe] = {}


def _model(content) -> ByteBpe:
    """One model per worker process and broadcast file."""
    if content.id not in _MODELS:
        _MODELS.clear()
        _MODELS[content.id] = ByteBpe(content.value)
    return _MODELS[content.id]


def cuts(length: int, capacity: int) -> list[int]:
    """Bounds of the pieces: all of ``capacity`` but the first."""
    first = length % capacity or min(length, capacity)
    return [0, *range(first, length + 1, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` as little-endian 32-bit integers."""
    content = _File(docs.sparkSession, path)

    def run(batch):
        model = _model(content)
        for part in slices(batch, "text", 1 << 20):
            rows, where = [], []
            for at, text in enumerate(part.column(1).to_pylist()):
                ids = np.append(model.encode(text), np.uint32(end_id)).astype("<u4")
                bounds = cuts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    coded = ids[a:b].tobytes()
                    rows.append((k, a, b - a, zlib.crc32(coded), coded if with_ids else None))
                    where.append(at)
            piece, start, length, crc, coded = zip(*rows)
            columns = {"doc_id": part.column(0).take(pa.array(where)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(coded, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))


# ---- the plan: (sequences, ((length, pieces per sequence), ...)) steps from counts per length


def lower_bound(counts: np.ndarray) -> int:
    """Fewest sequences by Martello and Toth: lengths over half never share, small ones fill what the large leave."""
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    k = np.arange(half + 1)
    apart = number[capacity] - number[half]
    shared = volume[capacity - k] - volume[half]  # over half, with room for k and more beside
    room = (number[capacity - k] - number[half]) * capacity - shared
    small = volume[half] - np.where(k > 0, volume[k - 1], 0)
    return int(apart + np.max(np.maximum(0, -((room - small) // capacity))))


def best_fit(counts: np.ndarray) -> list[tuple[int, tuple]]:
    """Best fit of falling lengths, for classes of equally filled sequences at once."""
    capacity = len(counts) - 1
    open_: dict[int, list] = {}  # space left -> [sequences, content] classes
    free = 0  # bit r: some class has r left

    def put(space, n, content):
        nonlocal free
        open_.setdefault(space, []).append((n, content))
        free |= 1 << space

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            fits = free >> size
            space = size + ((fits & -fits).bit_length() - 1) if fits else capacity
            each = space // size
            if fits:
                n, content = open_[space].pop()
                if not open_[space]:
                    free &= ~(1 << space)
            else:
                n, content = max(left // each, 1), ()
            whole = min(n, left // each)
            if whole:
                put(space - each * size, whole, (*content, (size, each)))
            left -= whole * each
            if n > whole and left:  # one more sequence takes the rest of this length
                put(space - left * size, 1, (*content, (size, left)))
                n, left = n - 1, 0
            if n > whole and fits:
                put(space, n - whole, content)
    return [(n, content) for classes in open_.values() for n, content in classes]


def dominated(filling: tuple, waste: int, left: int) -> bool:
    """Whether a piece would still fit, or some could give way to one as long or longer; ``left``: bit s is set if a length s is left over."""
    sums, groups = 1, 0  # bit s: some pieces, and some two or more, are s long
    for size in filling:
        groups |= (sums & ~1) << size
        sums |= sums << size
    grown = 1
    while grown <= waste:  # and up to ``waste`` longer
        step = min(grown, waste + 1 - grown)
        groups |= groups << step
        grown += step
    longer = (2 << waste) - 2
    for size in {0, *filling}:
        groups |= longer << size
    return bool(left & groups)


def fillings(counts: np.ndarray, space: int, allowed: int, width: int, steps: int):
    """Undominated fillings of ``space`` that waste at most ``allowed``, best fit first; at most ``width`` of them in ``steps`` trials."""
    sizes = np.flatnonzero(counts[: space + 1])[::-1].tolist()
    if not sizes:
        return [((), space)] if space <= allowed else []
    lengths = sum(1 << s for s in sizes)
    found, trials = [], 0
    smallest = sizes[-1]

    def grow(at, space, filling):
        nonlocal trials
        trials += 1
        if trials > steps or len(found) >= width:
            return
        fits = lengths & ((2 << min(space, at)) - 1) if space >= smallest else 0
        if not fits:
            if space <= allowed:
                found.append((filling, space))
            return
        stop = False
        while fits and not stop:
            size = fits.bit_length() - 1
            fits &= ~(1 << size)
            if filling.count(size) < counts[size]:
                grow(size, space - size, (*filling, size))
            stop = trials > steps or len(found) >= width
        if space <= allowed and not stop:
            found.append((filling, space))

    grow(space, space, ())
    out = []
    for filling, waste in found:
        spent = sum(1 << s for s in set(filling) if filling.count(s) >= counts[s])
        if not dominated(filling, waste, lengths & ~spent):
            times = min((int(counts[s]) // filling.count(s) for s in filling), default=0)
            out.append((waste, -times, len(filling), filling))
    return [(filling, waste) for waste, _, _, filling in sorted(out)]


def plan_sequences(counts: np.ndarray, nodes: int = 3000, width: int = 256, steps: int = 4000, every: int = 32) -> list[tuple[int, tuple]]:
    """Steps of the plan for ``counts[length]`` pieces; the other parameters bound the search, not the data."""
    counts = np.asarray(counts, np.int64).copy()
    capacity = len(counts) - 1
    total = int((counts * np.arange(capacity + 1)).sum())
    bound = lower_bound(counts)
    best = best_fit(counts)
    most = sum(n for n, _ in best)
    visited = 0

    def search(taken, used, waste, last):
        """``last``: the length of the step before and the fillings done with, so that equal lengths take theirs in one order only."""
        nonlocal best, most, visited
        visited += 1
        if visited % every == 1 or not counts.any():
            rest = best_fit(counts)
            if used + sum(n for n, _ in rest) < most:
                best = [*taken, *rest]
                most = sum(n for n, _ in best)
        if most == bound or visited >= nodes or used + lower_bound(counts) >= most or not counts.any():
            return
        size = int(np.flatnonzero(counts)[-1])
        counts[size] -= 1
        allowed = (most - 1) * capacity - total - waste
        options = fillings(counts, capacity - size, allowed, width, steps)
        counts[size] += 1
        before = last[1] if last and last[0] == size else frozenset()
        for index, (filling, spare) in enumerate(options):
            if filling in before:
                continue  # taken or passed over at the steps before
            content = tuple((s, (size, *filling).count(s)) for s in dict.fromkeys((size, *filling)))
            times = min(int(counts[s]) // k for s, k in content)
            if spare:
                times = min(times, ((most - 1) * capacity - total - waste) // spare)
            tried = before | {f for f, _ in options[: index + 1]}
            while times >= 1:
                for s, k in content:
                    counts[s] -= k * times
                search([*taken, (times, content)], used + times, waste + spare * times, (size, tried))
                for s, k in content:
                    counts[s] += k * times
                if most == bound or visited >= nodes:
                    return
                times = times // 2 if times > 8 else times - 1

    if most > bound:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * nodes + 2000))
        search([], 0, 0, None)
    return best


# ---- places


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", nodes: int = 3000) -> DataFrame:
    """The rows of :func:`pieces` with ``sequence_id`` and ``offset``, the place in the sequence, without gaps from 0."""
    coded = cut(pieces(docs, path, capacity, end_id, with_ids, id_col, text_col).withColumn("_at", F.monotonically_increasing_id()))
    return place(coded, capacity, nodes)


def place(coded: DataFrame, capacity: int, nodes: int = 3000) -> DataFrame:
    """``sequence_id`` and ``offset`` for pieces with a ``length``, by the plan of their counts; ``_at`` tells equal rows apart."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in coded.groupBy("length").count().collect():  # one row per length, ``capacity`` at most
        counts[row["length"]] = row["count"]
    steps = plan_sequences(counts, nodes)
    # Intervals of the pieces in order of length: where each begins, its first sequence, pieces per sequence, place of the first.
    begins = np.cumsum(counts) - counts
    used = np.zeros_like(counts)
    intervals, sequence = [], 0
    for n, content in steps:
        offset = 0
        for size, each in content:
            intervals.append((begins[size] + used[size], sequence, each, offset, size))
            used[size] += n * each
            offset += size * each
        sequence += n
    table = np.array(sorted(intervals), np.int64).reshape(-1, 5)
    columns = [c for c in coded.columns if c != "_at"]
    numbered = assign_ids(coded, ["length", "doc_id", "piece", "ids_crc32", "_at"], "_no")

    def run(batch):
        number = batch.column(len(columns)).to_numpy()
        step = table[np.searchsorted(table[:, 0], number, "right") - 1]
        rank = number - step[:, 0]
        arrays = [*batch.columns[: len(columns)], pa.array(step[:, 1] + rank // step[:, 2]), pa.array(step[:, 3] + rank % step[:, 2] * step[:, 4])]
        yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    kinds = dict(coded.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id bigint, offset bigint"
    return map_batches(numbered.select(*columns, "_no"), run, schema)
