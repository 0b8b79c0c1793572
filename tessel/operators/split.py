"""Deterministic, hash-ordered split, caps and samples (bucketed rank based)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.hashing import order_key
from tessel.plans.rank import bucketed_rank


def stratified_split(df: DataFrame, train_prop: float, seed: int = 42, label_col: str = "label",
                     id_col: str = "id", split_col: str = "split") -> DataFrame:
    """Per label, order rows by ``md5(seed:id)``; the first ``round_half_even(p*n)``
    go to ``train``, the rest to ``job``. Adds ``split``."""
    p = float(train_prop)
    d = df.withColumn("__h", order_key(id_col, seed))
    r = bucketed_rank(d, [label_col], "__h", "rid" if "rid" in df.columns else id_col, rank_col="__r", n_col="__n")
    n_train = F.bround(F.lit(p) * F.col("__n"), 0)
    return r.withColumn(split_col, F.when(F.col("__r") <= n_train, "train").otherwise("job")).drop("__h", "__r", "__n")


def take_first(df: DataFrame, n: int, order_col: str, id_col: str = "id") -> DataFrame:
    """The first ``n`` rows by ``(order_col, id)``, exact, at any ``n``: bucketed ranks of the
    order key, so no task orders the table or holds ``n`` rows."""
    n = int(n)
    if n <= 0:
        return df.limit(0)
    tie = "rid" if "rid" in df.columns else id_col
    number = df.schema[order_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    # a text that sorts like the number; its buckets hold 10,000 consecutive numbers
    text = F.lpad((F.col(order_col).cast("bigint") + F.lit(1 << 62)).cast("string"), 20, "0") if number else F.col(order_col).cast("string")
    r = bucketed_rank(df.withColumn("__ord", text), [], "__ord", tie, rank_col="__r", n_col=None, bucket_digits=16 if number else 3)
    return r.where(F.col("__r") <= n).drop("__r", "__ord")


def cap_rows(df: DataFrame, max_docs: int | None, seed: int = 42, id_col: str = "id",
             order_col: str | None = None) -> DataFrame:
    """Global row cap: keep ``max_docs`` rows, in ``order_col`` order when given
    (e.g. a file position) else in ``md5(seed:id)`` order."""
    if not max_docs or max_docs <= 0:
        return df
    if order_col is None:
        d = df.withColumn("__h", order_key(id_col, seed))
        return take_first(d, max_docs, "__h", id_col).drop("__h")
    return take_first(df, max_docs, order_col, id_col)


def shuffle_labels(df: DataFrame, seed: int = 42, label_col: str = "label", id_col: str = "id",
                   out_col: str = "label_shuffled") -> DataFrame:
    """Permute labels across rows, keeping the label histogram.

    Two global hash ranks: row with rank ``r`` under ``h1 = md5(seed:id:a)``
    receives the label of the row with rank ``r`` under ``h2 = md5(seed:id:b)``.
    An equi join on a unique rank — no skew, no collect.
    """
    d = df.withColumn("__h1", order_key(id_col, seed, "a")).withColumn("__h2", order_key(id_col, seed, "b"))
    r1 = bucketed_rank(d, [], "__h1", id_col, rank_col="__r", n_col=None).drop("__h2")
    donors = bucketed_rank(d.select(id_col, label_col, "__h2"), [], "__h2", id_col, rank_col="__r", n_col=None)
    donors = donors.select(F.col("__r").alias("__rd"), F.col(label_col).alias(out_col))
    return r1.join(donors, r1["__r"] == donors["__rd"]).drop("__r", "__rd", "__h1")
