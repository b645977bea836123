"""Subset selection, sampling, label codes and surrogate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planisphere.functions.seeded import hash_order
from planisphere.session import cut, parallelism

STRATEGIES = ("artist_first5", "random")
#: Rows that a heap per partition may hold, and how the hash is divided beyond that.
HEAP_ROWS, CODE_BITS, BUCKET_BITS = 10_000, 60, 12


def first_n_per_group(df: DataFrame, group: str, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows of every group in ``order``.

    The rank filter becomes a partial group limit before the shuffle, so a huge
    group sends at most ``n`` rows per input partition.
    """
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def random_subset(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows in seeded hash order, equal hashes by key.

    Small sizes come from bounded heaps per partition. Larger ones come from a filter: counts of the
    leading bits of the hash tell in which bucket the last row lies, and that bucket is divided
    further until it is small. The rows keep their partitions, and nothing is sorted but the last bucket.
    """
    if size <= HEAP_ROWS:
        return df.orderBy(hash_order(seed, F.col(key)), F.col(key)).limit(size)
    coded = df.withColumn("_code", F.conv(F.substring(hash_order(seed, F.col(key)), 1, CODE_BITS // 4), 16, 10).cast("bigint"))
    low, bits, left = 0, CODE_BITS, size  # the rows from ``low`` in a bucket of so many bits hold the last one
    inside = coded
    while bits:
        bits -= BUCKET_BITS
        counts = inside.groupBy(F.shiftright("_code", bits).alias("b")).count().orderBy("b").collect()
        if bits == CODE_BITS - BUCKET_BITS and sum(r["count"] for r in counts) <= size:
            return df
        for r in counts:
            if r["count"] > left:
                break
            left -= r["count"]
        low = r["b"] << bits
        inside = coded.filter((F.col("_code") >= low) & (F.col("_code") < low + (1 << bits)))
        if left == 0 or r["count"] <= HEAP_ROWS:
            break
    below = coded.filter(F.col("_code") < low).drop("_code")
    if left == 0:
        return below
    if r["count"] <= HEAP_ROWS:
        return below.unionByName(inside.drop("_code").orderBy(hash_order(seed, F.col(key)), F.col(key)).limit(left))
    # Many copies of one key: numbered by a distributed sort.
    copies = assign_ids(inside.withColumn("_hash", hash_order(seed, F.col(key))), ["_hash", key], "_no")
    return below.unionByName(copies.filter(F.col("_no") < left).drop("_code", "_hash", "_no"))


def head_sample(df: DataFrame, key: str, size: int = 100) -> DataFrame:
    return df.orderBy(key).limit(size)


def fetch_subset(df: DataFrame, strategy: str, size: int, seed: int = 42,
                 key: str = "item_id", group: str = "group_key") -> DataFrame:
    """Rows of one run: the first five per group, or a seeded random subset."""
    if strategy == "artist_first5":
        return first_n_per_group(df, group, key).drop("rn")
    if strategy == "random":
        return random_subset(df, key, size, seed)
    raise ValueError(f"unknown subset strategy {strategy!r}; known: {', '.join(STRATEGIES)}")


def label_encode(df: DataFrame, label: str, out: str = "y") -> DataFrame:
    """Codes 0..m-1 of the sorted distinct labels, joined back by label.

    The labels are numbered by a distributed sort; the join is left to the
    optimiser, which broadcasts the code table only when it is small.
    """
    codes = assign_ids(df.select(label).filter(F.col(label).isNotNull()).distinct(), [label], out)
    return df.join(codes, label, "left")


def assign_ids(df: DataFrame, order: list[str], out: str = "id", offset: int = 0) -> DataFrame:
    """Dense ids offset, offset+1, ... in ``order`` without a single-partition window.

    The rows are range-partitioned and sorted once and written to the checkpoint
    folder; per-partition counts (one row per partition) then shift the local
    row numbers.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parallelism(df.sparkSession))
    ordered = df.repartitionByRange(parts, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    # monotonically_increasing_id is partition * 2^33 + position within the partition.
    pos = F.monotonically_increasing_id()
    placed = cut(
        ordered.withColumn("_mono", pos)
        .withColumn("_part", F.shiftright(F.col("_mono"), 33).cast("int"))
        .withColumn("_pos", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mono")
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("c")).orderBy("_part").collect()
    starts, at = [], offset
    for row in counts:
        starts.append((row["_part"], at))
        at += row["c"]
    if not starts:
        return placed.withColumn(out, F.lit(None).cast("bigint")).drop("_part", "_pos")
    table = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    return (
        placed.join(F.broadcast(table), "_part")
        .withColumn(out, F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start")
    )


def landmarks_random(df: DataFrame, key: str, count: int, seed: int = 42) -> DataFrame:
    """``count`` landmark rows in seeded hash order."""
    return random_subset(df, key, count, seed)
