"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart have a word between them that is at
most one bit from the one and two bits from the other. Every fingerprint emits
its variants within half the radius; those that two fingerprints share collide.

* Only words of even parity serve as meeting points. An even fingerprint reaches
  them with 0 or 2 flips, an odd one with 1 flip, and the shortest path of any pair
  passes such a word, so half of the variants suffice and none is missed.
* The shuffle key is a bucket of variants: the exclusive or of a variant's four
  16-bit quarters. A fingerprint is sent once to each bucket that its variants fall
  into (121 or 16 rows instead of 2017 or 64); the variants themselves are made where they
  collide. A dense group of fingerprints spreads over all of these buckets.
* All members of a meeting point lie within the radius of the one that is nearest
  to it, so a star around it keeps every component and no pairs are listed.

Defined cases: a null text is an empty one; a text without words has fingerprint 0
and is linked like any other; fewer words than a shingle make one shingle; ties and
repeated rows share a class; a null id stays null and never names a component unless
its whole component has no id; other input columns do not matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.llm.common import give_back, map_batches, parts, slices
from planisphere.llm.components import components, local_roots
from planisphere.session import cut

BITS, FOLD = 64, 16
CHUNK_ROWS = 40_000
SHINGLE_CHUNK = 1 << 19


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle of ``width`` lower-cased words, repeats included."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    pairs = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[s:e], 42) for s, e in pairs), np.uint64, n)


def fingerprint(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per document: the bits set in over half of its hashes."""
    out = np.zeros(len(hashes), np.uint64)
    ones = np.zeros((len(hashes), BITS), np.int64)
    size = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(size)
    every = np.concatenate([hashes[i] for i in full]) if len(full) else np.empty(0, np.uint64)
    owner = np.repeat(full, size[full])
    for at in range(0, len(every), SHINGLE_CHUNK):
        bits = np.unpackbits(every[at : at + SHINGLE_CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = owner[at : at + SHINGLE_CHUNK]
        first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        ones[some[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    if len(full):
        out[full] = np.packbits(2 * ones[full] > size[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit integer."""

    def run(batch):
        for part in slices(batch, "text"):
            fps = fingerprint([shingle_hashes(t, width) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, run, "doc_id bigint, fp bigint")


def fold(x: np.ndarray) -> np.ndarray:
    y = x ^ (x >> np.uint64(32))
    return ((y ^ (y >> np.uint64(16))) & np.uint64(0xFFFF)).astype(np.int64)


class Ball:
    """The variants of one radius, grouped by how they change the bucket."""

    def __init__(self, radius: int):
        if not 1 <= radius <= 3:
            raise ValueError("a radius from 1 to 3 bits is supported")
        self.radius = radius
        # flips allowed for even and for odd fingerprints, and how near a centre has to be
        self.even, self.odd = {1: ((0,), (1,)), 2: ((0, 1), (0, 1)), 3: ((0, 2), (1,))}[radius]
        self.centre = radius - max(self.even + self.odd)
        self.by: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for flips in range(max(self.even + self.odd) + 1):
            found: dict[int, list[int]] = {}
            for bits in combinations(range(BITS), flips):
                mask = sum(1 << b for b in bits)
                found.setdefault(int(fold(np.array([mask], np.uint64))[0]), []).append(mask)
            for offset, masks in found.items():
                self.by.setdefault((flips, offset.bit_count()), {})[offset] = np.array(masks, np.uint64)

    def flips(self, odd: bool):
        return self.odd if odd else self.even

    def offsets(self, odd: bool) -> np.ndarray:
        return np.array(sorted({o for (f, _), masks in self.by.items() if f in self.flips(odd) for o in masks}), np.int64)

    def rows(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, fingerprint) for every bucket that holds variants of a fingerprint."""
        odd = np.bitwise_count(fps) % 2 == 1
        buckets, owners = [], []
        for parity in (False, True):
            some = fps[odd == parity]
            at = fold(some)[:, None] ^ self.offsets(parity)[None, :]
            buckets.append(at.ravel())
            owners.append(np.repeat(some, at.shape[1]))
        return np.concatenate(buckets), np.concatenate(owners)

    def variants(self, buckets: np.ndarray, fps: np.ndarray, near: bool):
        """(variant, fingerprint) of the rows; those close enough for a centre, or the others."""
        offset, odd = buckets ^ fold(fps), np.bitwise_count(fps) % 2 == 1
        weight, out = np.bitwise_count(offset), []
        for (flips, w), masks in self.by.items():
            if (flips <= self.centre) != near:
                continue
            take = (weight == w) & ((odd & (flips in self.odd)) | (~odd & (flips in self.even)))
            if not take.any():
                continue
            keys = np.array(sorted(masks), np.int64)
            table = np.stack([masks[k] for k in keys.tolist()])
            some = fps[take]
            made = some[:, None] ^ table[np.searchsorted(keys, offset[take])]
            out.append((made.ravel(), np.repeat(some, made.shape[1])))
        if not out:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def collide(self, buckets: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Star links among the fingerprints of whole buckets."""
        v, owner = self.variants(buckets, fps, True)
        order = np.lexsort((owner, v))
        v, owner = v[order], owner[order]
        first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.empty(0, bool)
        points, centres = v[first], owner[first]
        a, b = [owner], [centres[np.cumsum(first) - 1]] if len(v) else [owner]
        if len(points):
            # a bit map of the meeting points rejects nearly all of the wider variants at once
            size = 1 << max(16, int(len(points)).bit_length() + 4)
            mark = np.zeros(size, bool)
            slot = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
            mark[slot(points)] = True
            for at in range(0, len(fps), 4096):
                far, far_owner = self.variants(buckets[at : at + 4096], fps[at : at + 4096], False)
                hit = mark[slot(far)]
                far, far_owner = far[hit], far_owner[hit]
                place = np.minimum(np.searchsorted(points, far), len(points) - 1)
                hit = points[place] == far
                a.append(far_owner[hit])
                b.append(centres[place[hit]])
        a, b = np.concatenate(a), np.concatenate(b)
        keep = (a != b) & (np.bitwise_count(a ^ b) <= self.radius)  # verified on the fingerprints themselves
        return a[keep], b[keep]


def links(classes: DataFrame, radius: int = 3, fp_col: str = "fp") -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints within ``radius`` bits, directly or through others."""
    ball = Ball(radius)

    def emit(batch):
        for at in range(0, batch.num_rows, 2048):
            fps = np.asarray(batch.column(0).slice(at, 2048)).astype(np.int64).view(np.uint64)
            buckets, owners = ball.rows(fps)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(owners.view(np.int64))], ["bucket", "fp"])

    def meet(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        found_a, found_b, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

        def work(buckets, fps):
            a, b = ball.collide(buckets.astype(np.int64), fps.view(np.uint64))
            if len(a):
                nodes, roots = local_roots(np.concatenate([a.view(np.int64), *found_a]), np.concatenate([b.view(np.int64), *found_b]))
                found_a[:], found_b[:] = [nodes[nodes != roots]], [roots[nodes != roots]]

        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                buckets, fps = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(buckets, buckets[-1]))  # the last bucket may go on
                if whole:
                    work(buckets[:whole], fps[:whole])
                held, n = [(buckets[whole:], fps[whole:])], len(buckets) - whole
        if n:
            work(*(np.concatenate(x) for x in zip(*held)))
        a, b = found_a[0], found_b[0]
        give_back()
        for at in range(0, len(a), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 65536]), pa.array(b[at : at + 65536])], ["a", "b"])

    spark = classes.sparkSession
    rows = map_batches(classes.select(F.col(fp_col).alias("fp")), emit, "bucket int, fp bigint")
    dealt = rows.repartition(parts(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "a bigint, b bigint")


def near_duplicates(df: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    docs = cut(fingerprints(df, width, id_col, text_col))
    classes = docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = components(links(classes, radius)).withColumnRenamed("node", "fp")
    named = cut(classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "first_id"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    table = named.join(lowest, "component").select("fp", "component_id")
    return docs.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, the one of the smallest id (nulls last), with the columns it came with."""

    def run(batch):
        for part in slices(batch, "text"):
            fps = fingerprint([shingle_hashes(t or "", width) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps.view(np.int64))], ["row", "text", "at", "fp"])

    rest = [c for c in df.columns if c != text_col]  # the text travels once, beside the other columns
    packed = df.select(F.struct(*rest).alias("row"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = cut(map_batches(packed, run, f"row {packed.schema['row'].dataType.simpleString()}, text string, at bigint, fp bigint"))
    order = F.struct(F.col(f"row.{id_col}").isNull().alias("n"), F.col(f"row.{id_col}").alias("i"), "at")
    classes = cut(rows.groupBy("fp").agg(F.min(order).alias("first")))
    linked = components(links(classes, radius)).withColumnRenamed("node", "fp")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "first")
    # the rows that stay: one per component, each in its own class
    stay = named.groupBy("component").agg(F.min(F.struct("first", "fp")).alias("m")).select(F.col("m.fp").alias("fp"), F.col("m.first.at").alias("stays"))
    return rows.join(stay, (rows["fp"] == stay["fp"]) & (rows["at"] == stay["stays"]), "left_semi").select(*[F.col("text" if c == text_col else f"row.{c}").alias(c) for c in df.columns])
