"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1024


def hot_keys(df: DataFrame, key: str, rows: int, share: int = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``rows / share`` rows, with the number of salts each needs.

    At most ``share`` keys can qualify, so the result may always be broadcast.
    """
    limit = max(rows // share, 1000)
    return (
        df.groupBy(F.col(key).alias("_hot"))
        .count()
        .filter(F.col("count") > limit)
        .select("_hot", F.ceil(F.col("count") / F.lit(limit)).cast("int").alias("_salts"))
    )


def add_salt(df: DataFrame, key: str, hot: DataFrame, *spread: str) -> DataFrame:
    """Many-side: ``_salt`` spreads the rows of a hot key over its salts, 0 elsewhere."""
    joined = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # Rows without a key match nothing; they are spread as widely as the hottest key could be.
    salts = F.when(F.col(key).isNull(), F.lit(HOT_SHARE)).otherwise(F.coalesce("_salts", F.lit(1)))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), salts.cast("bigint")).cast("int")
    return joined.withColumn("_salt", salt).drop("_hot", "_salts")


def repeat_for_salt(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """One-side: one copy of the row per salt of its key."""
    joined = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    return joined.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot", "_salts")


def salted_join(many: DataFrame, one: DataFrame, key: str, rows: int, *spread: str, how: str = "inner") -> DataFrame:
    """Equi-join of a skewed table with a table that has one row per ``key``."""
    hot = hot_keys(many, key, rows)
    left = add_salt(many, key, hot, *spread)
    right = repeat_for_salt(one, key, hot)
    return left.join(right, [key, "_salt"], how).drop("_salt")
