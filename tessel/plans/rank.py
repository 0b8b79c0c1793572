"""Bucketed rank: a per-group ``row_number`` that does not put a group in one task.

``row_number() over (partition by label order by h)`` hash-partitions by
``label``; with two labels that is two tasks however large the corpus. Here the
order key ``h`` (an md5 hex digest) is cut into ``16^k`` buckets by its first
``k`` hex digits. Because buckets are ranges of ``h``, the global order is
"bucket, then h within bucket", so

    rank = (rows of the group in earlier buckets) + row_number within bucket

is exactly the plain window's rank. The bucket table (``groups x 16^k`` rows of
counts) is tiny and is joined back on ``(group, bucket)``; AQE broadcasts it
after measuring it. The large window is partitioned by ``(group, bucket)``,
so a group holding a third of the rows is spread over ``16^k`` keys.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.session import scratch_path


def bucketed_rank(df: DataFrame, group_cols: Sequence[str], order_col: str,
                  tie_col: str, rank_col: str = "rank", n_col: str | None = "n",
                  weight_col: str | None = None, prefix_col: str | None = None,
                  bucket_digits: int = 3) -> DataFrame:
    """Add ``rank_col`` (1-based rank of the row within its group, ordered by
    ``order_col`` then ``tie_col``) and optionally ``n_col`` (group size).

    With ``weight_col``/``prefix_col`` also add the running sum of the weight
    over the *preceding* rows of the group (exclusive prefix sum), computed by
    the same bucket decomposition.
    """
    g = list(group_cols)
    b = "__bucket"
    d = df.withColumn(b, F.substring(F.col(order_col), 1, bucket_digits))
    aggs = [F.count(F.lit(1)).alias("__bn")]
    if weight_col:
        aggs.append(F.sum(F.col(weight_col)).alias("__bw"))
    counts = d.groupBy(*g, b).agg(*aggs)
    wprev = (Window.partitionBy(*g).orderBy(b)
             .rowsBetween(Window.unboundedPreceding, -1))
    offs = counts.withColumn("__off", F.coalesce(F.sum("__bn").over(wprev), F.lit(0)))
    keep = [*g, b, "__off"]
    if n_col:
        offs = offs.withColumn(n_col, F.sum("__bn").over(Window.partitionBy(*g)))
        keep.append(n_col)
    if weight_col:
        offs = offs.withColumn("__woff", F.coalesce(F.sum("__bw").over(wprev), F.lit(0)))
        keep.append("__woff")
    offs = offs.select(*keep)
    within = Window.partitionBy(*g, b).orderBy(F.col(order_col), F.col(tie_col))
    # null-safe on the group keys: a null label is a group of its own
    offs = offs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(g)],
                       *[c for c in keep if c not in g])
    cond = [d[c].eqNullSafe(offs[f"__k{i}"]) for i, c in enumerate(g)] + [d[b] == offs[b]]
    out = (d.join(offs, on=cond, how="inner")
           .drop(offs[b]).drop(*[f"__k{i}" for i in range(len(g))])
           .withColumn(rank_col, F.col("__off") + F.row_number().over(within)))
    if weight_col:
        wrun = within.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(prefix_col or "prefix",
                             F.col("__woff") + F.coalesce(F.sum(weight_col).over(wrun), F.lit(0)))
        out = out.drop("__woff")
    return out.drop(b, "__off")


def top_k(df: DataFrame, value_col: str, tie_col: str, k: int) -> DataFrame:
    """Exact top-``k`` rows by ``value_col`` desc, then ``tie_col`` asc, without
    gathering candidates into one task.

    A histogram of ``value_col`` (one row per distinct value) finds the cut
    value ``cv`` and how many rows ``need`` to take at it; rows above the cut
    pass a filter, rows at the cut are ranked by ``tie_col`` with the bucketed
    rank (buckets = leading characters, which preserve string order).
    """
    hist = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy(F.desc(value_col)).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    cut = hist.where((F.col("__before") < k) & (F.col("__before") + F.col("__c") >= k))
    cv = cut.select(value_col).scalar()
    need = cut.select((F.lit(k) - F.col("__before")).alias("n")).scalar()
    above = df.where(cv.isNull() | (F.col(value_col) > cv))
    ties = df.where(F.col(value_col) == cv).withColumn("__tk", F.col(tie_col).cast("string"))
    ranked = bucketed_rank(ties, [], "__tk", tie_col, rank_col="__r", n_col=None)
    return above.unionByName(ranked.where(F.col("__r") <= need).drop("__r", "__tk"))


def row_numbers(df: DataFrame, order: Sequence, number_col: str = "row_no") -> DataFrame:
    """``df`` with ``number_col``: 0, 1, 2, ... in ``order`` (which should tell all rows apart).

    One range-partitioned sort, written once; rows are numbered within their partition and
    only the partitions' sizes (one row each) are added up. Give key columns only: texts
    have no place in the sort."""
    spark = df.sparkSession
    path = scratch_path(spark, f"numbered-{uuid.uuid4().hex[:12]}")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df.sort(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", at).write.parquet(path)
    s = spark.read.parquet(path)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = s.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    j = s.join(F.broadcast(sizes.select("__part", "__before")), "__part")  # one row per partition
    return j.withColumn(number_col, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def first_n(df: DataFrame, n: int, order: Sequence[str], key: str) -> DataFrame:
    """Exactly the first ``n`` rows in ``order``, of any size: a sort of the small columns and a semi join on the unique ``key``."""
    rows = row_numbers(df.select(key, *[c for c in order if c != key]), list(order))
    return df.join(rows.where(F.col("row_no") < int(n)).select(key), key, "left_semi")
