"""Label mapping joins: label-map dimension with an unknown-label policy,
and raw-label fallback over several fields."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import norm_label, py_strip

POLICIES = ("drop", "keep", "other")


def label_map_frame(spark: SparkSession, mapping: Mapping[str, str] | Sequence[tuple]) -> DataFrame:
    """Dimension table ``(key, label)`` from a driver-side mapping.

    Keys are normalised like row values; null/blank labels are skipped; when
    two raw keys normalise to the same key the later one wins.
    """
    items = list(mapping.items()) if isinstance(mapping, Mapping) else list(mapping)
    rows = [(i, str(k), None if v is None else str(v)) for i, (k, v) in enumerate(items)]
    df = spark.createDataFrame(rows, "pos long, raw_key string, label string")
    return (df.where(F.col("label").isNotNull() & (F.trim("label") != ""))
            .withColumn("key", norm_label("raw_key"))
            .groupBy("key").agg(F.max_by("label", "pos").alias("label")))


def apply_label_map(df: DataFrame, label_map: DataFrame, policy: str = "drop",
                    other_label: str = "other", raw_col: str = "label_raw",
                    out_col: str = "label", small_map: bool = False) -> DataFrame:
    """Map ``raw_col`` through ``label_map`` (``key, label``).

    Unmapped (or empty-mapped) values follow ``policy``: ``drop`` -> null,
    ``keep`` -> the normalised raw value, ``other`` -> ``other_label``.
    Spark broadcasts the map when its size allows; ``small_map`` forces it for a map
    whose bound the caller knows.
    """
    policy = (policy or "drop").strip().lower()
    if policy not in POLICIES:
        raise ValueError(f"unknown label policy {policy!r}")
    m = label_map.select(F.col("key").alias("__key"), F.col("label").alias("__mapped"))
    if small_map:
        m = F.broadcast(m)
    raw_norm = norm_label(F.col(raw_col))
    d = df.withColumn("__raw_norm", raw_norm)
    j = d.join(m, d["__raw_norm"] == m["__key"], "left")
    mapped = F.when(F.col("__mapped") != "", F.col("__mapped"))
    if policy == "keep":
        fallback = F.col("__raw_norm")
    elif policy == "other":
        fallback = F.lit(other_label)
    else:
        fallback = F.lit(None).cast("string")
    out = F.when(F.col(raw_col).isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(mapped, fallback))
    return j.withColumn(out_col, out).drop("__key", "__mapped", "__raw_norm")


def label_fallback(df: DataFrame, fields: Sequence[str], out_col: str = "label_raw") -> DataFrame:
    """Raw label = first of ``fields`` holding a non-blank value (stripped)."""
    vals = [F.when(py_strip(F.col(c).cast("string")) != "", py_strip(F.col(c).cast("string"))) for c in fields]
    return df.withColumn(out_col, F.coalesce(*vals) if vals else F.lit(None).cast("string"))
