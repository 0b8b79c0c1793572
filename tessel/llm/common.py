"""Helpers shared by the operators: table reading, shared scratch tables, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir``
    and read it back: lineage is cut, lost executors cost nothing that was
    written, and later plans see the true size of the table."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def count_rows(df: DataFrame) -> int:
    """Row count only; of a stored table it comes from the Parquet footers."""
    return int(df.agg(F.count(F.lit(1)).alias("n")).first()["n"])


def arrow_slices(batches: Iterator[pa.RecordBatch], text_col: str = "text",
                 max_bytes: int = 4 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds at most ``max_bytes`` of text
    (or a single longer text): bounds the arrays a task derives from it."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text_col))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        at = 0
        while at < n:
            cum = np.cumsum(size[at:at + max_rows])
            take = max(1, int(np.searchsorted(cum, max_bytes, side="right")))
            yield batch.slice(at, min(take, n - at))
            at += take
    pa.default_memory_pool().release_unused()  # a worker process lives on after its task


def byte_texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def long_key(col):
    """A non-null key for joins: null ids become one reserved value."""
    return F.coalesce(col.cast("bigint"), F.lit(-(2 ** 63) + 1))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
