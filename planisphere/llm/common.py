"""Shared pieces of the text operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ``[^\\x20\\x09-\\x0D]+`` for Spark and DuckDB: a word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Consecutive parts of a batch, each with about ``limit`` bytes (of a list: entries) in ``column`` or a single row."""
    column = batch.column(batch.schema.get_field_index(column))
    if len(column) == 0:
        return
    buffers, offset = column.buffers(), column.offset
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[offset : offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = max(int(np.searchsorted(ends, ends[at] + limit, "right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with every nested field nullable, as a schema string declares it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(nullable(kind.key_type), nullable(kind.item_type))
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, nullable(kind.value_type)))
    return kind


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and waits for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(function):
    """A function of Arrow tables for grouped data that leaves no freed memory in the worker."""

    def run(*tables):
        give_back()
        out = function(*tables)
        give_back()
        return out

    # Spark tells a function with the group's key from one without by its arguments
    return (lambda t: run(t)) if function.__code__.co_argcount == 1 else (lambda t, u: run(t, u))


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch that yields record batches."""

    def run(batches):
        for batch in batches:
            yield from function(batch)
            del batch
            give_back()

    return df.mapInArrow(run, schema)


def parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
