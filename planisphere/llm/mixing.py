"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

The mix has ``budget`` times the words of all documents. Sources, ordered by code
point with null last, get weights ``weights`` repeating; a source whose share
would exceed ``max_epochs`` times its words is clamped there and the excess goes
to the others by weight, until no share exceeds its clamp. Every document is then
taken a whole number of times, and the rest of the target goes to documents in
the order of a seeded hash, as long as each brings the sum nearer to the target.

Only sums per source and per (source, hash bucket) are shuffled; no step needs
the rows of a source together, so a source may hold any share of all rows.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source
is a source of its own, ordered last; an empty table gives an empty result; rows with the
same id and size (repeated rows) are drawn together as one unit; other columns
are kept by :func:`take`, also those named like its own, and do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planisphere.functions.seeded import hash_order
from planisphere.llm.common import WORD, parts
from planisphere.session import cut

BUCKET_DIGITS = 3


def with_draw(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows with ``_size``, ``_source``, and the seeded ``_draw`` (32 hexadecimal digits)."""
    return docs.select(
        "*",
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"),
        F.col(source_col).cast("string").alias("_source"),
        hash_order(seed, F.col(id_col)).alias("_draw"),
    )


def numbered(sources: DataFrame) -> DataFrame:
    """``_rank`` from 0 by code point, null last; a range sort, no partition holds all sources."""
    n = parts(sources.sparkSession)
    order = F.col("_source").asc_nulls_last()
    placed = cut(sources.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition, so the running sum over them is bounded.
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn("_rank", F.col("_start") + place).drop("_part", "_start", "_at")


def water_level(sources: DataFrame, total: float) -> float:
    """Level of the free sources: rounds of clamping, each one aggregate, until no further source is clamped."""
    level, clamped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_weight") * F.lit(level) >= F.col("_cap")
        row = sources.agg(
            F.sum(F.when(full, F.col("_cap"))).alias("c"), F.sum(F.when(~full, F.col("_weight"))).alias("w"), F.count(F.when(full, 1)).alias("n")
        ).first()
        if row.w is None or row.n == clamped:
            return level or 0.0
        clamped, level = row.n, (total - (row.c or 0.0)) / row.w


def plan_mix(sized: DataFrame, weights=(5.0, 2.0, 1.0), budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row per source: ``_source``, ``source_size``, ``target``, ``_whole`` repetitions, and up to which draw one more is taken."""
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    ranked = numbered(totals)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = cut(ranked.select("_source", "source_size", weight.alias("_weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("_cap")))
    size = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, budget * size)
    target = F.least(F.col("_cap"), F.col("_weight") * F.lit(level))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    shares = cut(
        sources.select("_source", "source_size", target.alias("target"), whole.alias("_whole")).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    )

    # The bucket of the draw in which the running sum of a source passes its rest, then the last unit taken in it.
    bucket = F.substring("_draw", 1, BUCKET_DIGITS)
    sums = sized.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_size").alias("_n"))
    running = sums.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
    same = lambda a, b: a["_source"].eqNullSafe(b["_source"])
    edge = running.join(shares.select("_source", "_rest"), same(running, shares)).filter((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_n") <= F.col("_rest")) & (F.col("_n") > 0) & (F.col("_rest") > 0))
    edge = cut(edge.select(running["_source"], "_bucket", (F.col("_upto") - F.col("_n")).alias("_before"), "_rest"))
    units = sized.join(edge.withColumnRenamed("_source", "_edge"), F.col("_source").eqNullSafe(F.col("_edge")) & (bucket == F.col("_bucket")))
    units = units.groupBy("_source", "_before", "_rest", "_draw", "_size").agg(F.sum("_size").alias("_unit"))
    upto = F.col("_before") + F.sum("_unit").over(Window.partitionBy("_source").orderBy("_draw", "_size").rowsBetween(Window.unboundedPreceding, 0))
    last = units.withColumn("_upto", upto).filter(F.col("_upto") - F.col("_unit") / 2 <= F.col("_rest")).groupBy("_source").agg(F.max(F.struct("_draw", "_size")).alias("_last"))
    with_edge = shares.join(edge.select(F.col("_source").alias("_edge"), "_bucket"), F.col("_source").eqNullSafe(F.col("_edge")), "left").drop("_edge")
    return cut(with_edge.join(last.withColumnRenamed("_source", "_edge"), F.col("_source").eqNullSafe(F.col("_edge")), "left").drop("_edge", "_rest"))


def repetitions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` of :func:`with_draw` with ``source_size``, ``target``, ``repetitions`` and ``taken`` by their source's plan."""
    bucket = F.substring("_draw", 1, BUCKET_DIGITS)
    extra = (bucket < F.col("_bucket")) | ((bucket == F.col("_bucket")) & F.coalesce(F.struct("_draw", "_size") <= F.col("_last"), F.lit(False)))
    joined = rows.join(plan.withColumnRenamed("_source", "_plan"), F.col("_source").eqNullSafe(F.col("_plan")))
    times = F.col("_whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    out = joined.withColumn("repetitions", times).withColumn("taken", F.col("repetitions") * F.col("_size"))
    return out.drop("_plan", "_whole", "_bucket", "_last")


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, repetitions, taken``."""
    rows = with_draw(docs.select(id_col, text_col, source_col), seed, id_col, text_col, source_col)
    sized = cut(rows.select(F.col(id_col).alias("doc_id"), "_source", "_size", "_draw"))
    done = repetitions(sized, plan_mix(sized, weights, budget, max_epochs))
    return done.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "repetitions", "taken")


def take(docs: DataFrame, weights=(5.0, 2.0, 1.0), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with, whatever their names."""
    rest = [c for c in docs.columns if c != text_col]  # the text travels once, beside the other columns
    packed = docs.select(F.struct(*rest).alias("_row"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), F.col(source_col).alias("_from"))
    drawn = with_draw(packed, seed, "_id", "_text", "_from")
    sized = cut(drawn.select("_source", "_size", "_draw"))
    done = repetitions(drawn, plan_mix(sized, weights, budget, max_epochs)).filter(F.col("repetitions") > 0)
    copies = done.select("_row", "_text", F.explode(F.sequence(F.lit(1), F.col("repetitions").cast("int"))).alias("_copy"))
    return copies.select(*[F.col("_text" if c == text_col else f"_row.{c}").alias(c) for c in docs.columns])


#: DuckDB: the same rows from exact arithmetic on one machine.
SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat_ws(':', '42', doc_id)) AS draw FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), sources AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM totals
), wanted AS (
  SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS total, count(*) AS n FROM sources
), rounds AS (
  SELECT 0 AS round, -1.0::DOUBLE AS level
  UNION ALL
  SELECT round + 1, (SELECT (total - coalesce(sum(cap) FILTER (weight * level >= cap), 0.0)) / sum(weight) FILTER (NOT weight * level >= cap) FROM sources, wanted GROUP BY total)
  FROM rounds WHERE level IS NOT NULL AND round <= (SELECT n FROM wanted)
), shares AS (
  SELECT source, source_size, least(cap, weight * level) AS target FROM sources, (SELECT max(level) AS level FROM rounds)
), rest AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM shares
), units AS (
  SELECT source, draw, size, sum(size)::BIGINT AS unit FROM sized GROUP BY ALL
), upto AS (
  SELECT *, sum(unit) OVER (PARTITION BY source ORDER BY draw, size ROWS UNBOUNDED PRECEDING) AS upto FROM units
)
SELECT s.doc_id, s.size, r.source_size, r.target,
  (s.size * (r.whole + CASE WHEN target - whole * source_size > 0 AND u.upto - u.unit / 2 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source
JOIN upto u ON s.source IS NOT DISTINCT FROM u.source AND s.draw = u.draw AND s.size = u.size
"""
