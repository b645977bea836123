"""Embedding tables: reading, float32 blobs, and insert-or-ignore ingestion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planisphere.functions.vectors import doubles, is_valid


def scan_embeddings(spark: SparkSession, path: str, key: str = "vec_id", group: str = "label",
                    vec: str = "embedding", dim: int | None = None, on_bad: str = "fail") -> DataFrame:
    """item_id, group_key and a double vector.

    ``on_bad``: ``fail`` stops at the first vector that is null, of the wrong
    length, or holds NaN or infinity; ``drop`` leaves such rows out on request.
    """
    df = spark.read.parquet(path).select(
        F.col(key).alias("item_id"), F.col(group).alias("group_key"), doubles(F.col(vec)).alias("embedding")
    )
    ok = is_valid(F.col("embedding"), dim)
    if on_bad == "drop":
        return df.filter(ok)
    if on_bad != "fail":
        raise ValueError("on_bad is 'fail' or 'drop'")
    message = F.concat(F.lit("invalid vector for item "), F.col("item_id").cast("string"))
    checked = F.when(ok, F.col("embedding")).otherwise(F.raise_error(message).cast("array<double>"))
    return df.withColumn("embedding", checked)


def decode_blob(df: DataFrame, blob: str = "embedding") -> DataFrame:
    """Little-endian float32 bytes to array<float>; a length that is no multiple of 4 is an error."""
    names = df.columns
    at = names.index(blob)

    def run(batches):
        for batch in batches:
            col = batch.column(at)
            sizes = np.array([len(b) if b is not None else 0 for b in col.to_pylist()], dtype=np.int64)
            if (sizes % 4).any():
                raise ValueError("a vector blob is not a whole number of float32 values")
            raw = b"".join(b for b in col.to_pylist() if b is not None)
            flat = pa.array(np.frombuffer(raw, "<f4"))
            offsets = np.concatenate([[0], np.cumsum(sizes // 4)]).astype(np.int32)
            mask = pa.array(np.asarray(col.is_null()))
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=mask if col.null_count else None)
            arrays = [lists if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, _with_type(df, blob, "array<float>"))


def encode_blob(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """array<float> to little-endian float32 bytes."""
    names = df.columns
    at = names.index(vec)

    def run(batches):
        for batch in batches:
            col = batch.column(at)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
            sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * 4
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            nulls = np.asarray(col.is_null())
            cells = [None if nulls[i] else flat[offsets[i]:offsets[i + 1]] for i in range(len(col))]
            arrays = [pa.array(cells, pa.binary()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, _with_type(df, vec, "binary"))


def _with_type(df: DataFrame, column: str, kind: str) -> str:
    return ", ".join(
        f"`{f.name}` {kind if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields
    )


def ingest_ignore(existing: DataFrame, incoming: DataFrame, key: str, arrival: str) -> DataFrame:
    """Rows to append: unknown keys only, the earliest row of each key within the batch.

    The keep-first rank is a group limit of one, so a key repeated millions of
    times still sends one row per input partition.
    """
    w = Window.partitionBy(key).orderBy(arrival)
    first = incoming.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    return first.join(existing.select(key), key, "left_anti")
