"""Corpus statistics and audit aggregations.

Everything here is a grouped aggregation with partial (map-side) combine;
exact percentiles use Spark's ``percentile`` whose state is a value->count
map, so a hot group costs memory proportional to its *distinct* values.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import norm_text


def counts(df: DataFrame, cols: Sequence[str] | str, name: str = "n_docs") -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def check_stats(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Per label count, with the totals (docs, distinct labels) on every row."""
    c = counts(df, label_col)
    whole = Window.partitionBy()
    return (c.withColumn("docs", F.sum("n_docs").over(whole))
            .withColumn("n_labels", F.count(F.lit(1)).over(whole)))


def corpus_stats(df: DataFrame, text_col: str = "text", label_col: str = "label",
                 order_col: str = "id") -> DataFrame:
    """Per label: docs, duplicates (2nd+ occurrence of the md5 of the normalised
    text, first by ``order_col``), median and p90 of whitespace token counts.

    Rows are first counted per ``(digest, label, tokens)``; the first occurrence of a digest is a
    ``min`` over that table, and percentiles weigh its counts: no row meets its digest again.
    """
    t = norm_text(text_col)
    d = (df.withColumn("__t", t).where(F.col("__t") != "").where(F.trim(F.col(label_col)) != "")
         .select(F.trim(F.col(label_col)).alias(label_col), F.md5("__t").alias("__m"),
                 F.size(F.split("__t", " ")).alias("__tok"), F.col(order_col).alias("__o")))
    per = d.groupBy("__m", label_col, "__tok").agg(F.count(F.lit(1)).alias("__c"), F.min("__o").alias("__o"))
    first = per.groupBy("__m").agg(F.min("__o").alias("__first"))
    j = per.join(first, "__m")
    return (j.groupBy(label_col).agg(
        F.sum("__c").cast("bigint").alias("n_docs"),
        F.sum(F.col("__c") - F.when(F.col("__o") == F.col("__first"), 1).otherwise(0)).cast("bigint").alias("n_dups"),
        F.round(F.percentile("__tok", 0.5, F.col("__c")), 6).alias("median_tokens"),
        F.round(F.percentile("__tok", 0.9, F.col("__c")), 6).alias("p90_tokens")))


LENGTH_PCTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def length_stats(df: DataFrame, len_col: str = "text_len", by: Sequence[str] = ("label", "split")) -> DataFrame:
    """Length distribution globally and per ``by`` combination (GROUPING SETS).
    The global row has ``scope='all'`` and null ``by`` columns."""
    by = list(by)
    L = F.col(len_col).cast("double")
    pct = F.percentile(L, list(LENGTH_PCTS))
    aggs = [F.count(F.lit(1)).alias("n"), F.min(L).alias("min"), F.max(L).alias("max"),
            F.round(F.avg(L), 6).alias("mean"), F.round(F.stddev_samp(L), 6).alias("std"),
            pct.alias("__p"),
            F.round(F.avg((L < 200).cast("double")), 6).alias("share_lt_200"),
            F.round(F.avg((L > 5000).cast("double")), 6).alias("share_gt_5000"),
            F.grouping_id(*by).alias("__gid")]
    g = df.groupingSets([by, []], *by).agg(*aggs)
    names = ["p01", "p05", "p25", "median", "p75", "p95", "p99"]
    cols = [F.round(F.col("__p")[i], 6).alias(n) for i, n in enumerate(names)]
    return g.select(F.when(F.col("__gid") == 0, "by_group").otherwise("all").alias("scope"),
                    *by, "n", "min", *cols, "max", "mean", "std", "share_lt_200", "share_gt_5000")


def top_values(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """Top-``n`` most frequent values (count desc, value asc)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_docs"))
            .orderBy(F.desc("n_docs"), F.asc(col)).limit(int(n)))


def source_purity(df: DataFrame, source_col: str = "source", label_col: str = "label") -> DataFrame:
    """Per-source label purity summary: number of sources, sources with purity
    1.0 / >= 0.95, and the share of documents that come from them."""
    per = df.groupBy(source_col, label_col).agg(F.count(F.lit(1)).alias("c"))
    site = per.groupBy(source_col).agg(F.sum("c").alias("n"), F.max("c").alias("m"))
    site = site.withColumn("purity", F.col("m") / F.col("n"))
    return site.agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.sum(F.when(F.col("purity") >= 1.0, 1).otherwise(0)).cast("bigint").alias("n_pure"),
        F.sum(F.when(F.col("purity") >= 0.95, 1).otherwise(0)).cast("bigint").alias("n_ge95"),
        F.round(F.avg("purity"), 6).alias("mean_purity"),
        F.round(F.min("purity"), 6).alias("min_purity"),
        F.round(F.sum(F.when(F.col("purity") >= 1.0, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("docs_share_pure"),
        F.round(F.sum(F.when(F.col("purity") >= 0.95, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("docs_share_ge95"))


def crosstab_share(df: DataFrame, row_col: str, label_col: str = "label") -> DataFrame:
    """Row-normalised crosstab in long form: share of each label per ``row_col`` value."""
    per = df.groupBy(row_col, label_col).agg(F.count(F.lit(1)).alias("n_docs"))
    tot = per.groupBy(row_col).agg(F.sum("n_docs").alias("__t"))
    return (per.join(tot, row_col)
            .select(row_col, label_col, "n_docs", F.round(F.col("n_docs") / F.col("__t"), 6).alias("share")))


def split_label_shift(df: DataFrame, split_col: str = "split", label_col: str = "label",
                      a: str = "train", b: str = "job") -> DataFrame:
    """Label proportions per split and their difference ``a - b``."""
    per = df.groupBy(label_col).agg(
        F.sum(F.when(F.col(split_col) == a, 1).otherwise(0)).alias("__na"),
        F.sum(F.when(F.col(split_col) == b, 1).otherwise(0)).alias("__nb"))
    whole = Window.partitionBy()
    per = (per.withColumn("share_train", F.col("__na") / F.sum("__na").over(whole))
           .withColumn("share_job", F.col("__nb") / F.sum("__nb").over(whole)))
    return per.select(label_col, F.col("__na").cast("bigint").alias("n_train"), F.col("__nb").cast("bigint").alias("n_job"),
                      F.round("share_train", 6).alias("share_train"), F.round("share_job", 6).alias("share_job"),
                      F.round(F.col("share_train") - F.col("share_job"), 6).alias("shift"))
