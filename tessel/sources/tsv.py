"""Labelled TSV sink and scan, sharded export.

The TSV form of a view is ``id, label, label_raw, modality, <source_field>,
text`` with a header and minimal quoting (fields holding a tab, quote or
newline are quoted, quotes doubled). Reading it needs ``multiLine``, which
makes a file unsplittable, so parquet stays the working format and TSV is an
interchange sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.plans.rank import row_numbers

# The interchange file's format and column order.
TSV_COLUMNS = ("id", "label", "label_raw", "modality")
TSV_OPTIONS = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def write_view_tsv(df: DataFrame, path: str, source_field: str = "source") -> str:
    cols = [*TSV_COLUMNS, source_field, "text"]
    (df.select(*[F.col(c).cast("string") for c in cols]).write.mode("overwrite")
     .options(**{k: v for k, v in TSV_OPTIONS.items() if k != "multiLine"}).csv(path))
    return path


def read_labelled_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string; rows with an empty text or label are dropped (white space is not empty)."""
    df = spark.read.options(**TSV_OPTIONS).csv(path)
    return df.where((F.col("text") != "") & (F.col("label") != ""))


def write_shards(df: DataFrame, path: str, shard_size: int) -> str:
    """Parquet shards of at most ``shard_size`` rows each (``maxRecordsPerFile``)."""
    df.write.mode("overwrite").option("maxRecordsPerFile", int(shard_size)).parquet(path)
    return path


def write_exact_shards(df: DataFrame, path: str, shard_size: int, key: str, order: list[str], prefix: str = "train") -> str:
    """Parquet shards ``<prefix>_000``, ``_001``, ... of exactly ``shard_size`` rows (the last one may be shorter) in ``order``: one
    file each, in a folder ``shard=<name>``. Rows are numbered on the small columns and meet their
    shard by the unique ``key``; the write commits all shards or none."""
    no = row_numbers(df.select(key, *[c for c in order if c != key]), list(order))
    shard = F.floor(F.col("row_no") / int(shard_size)).cast("bigint")
    name = F.concat(F.lit(f"{prefix}_"), F.when(shard < 1000, F.lpad(shard.cast("string"), 3, "0")).otherwise(shard.cast("string")))
    rows = df.join(no.select(key, name.alias("shard"), "row_no"), key)
    rows.repartition("shard").sortWithinPartitions("shard", "row_no").drop("row_no").write.mode("overwrite").partitionBy("shard").parquet(path)
    return path
