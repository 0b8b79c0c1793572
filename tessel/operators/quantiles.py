"""Exact quantiles of any number of rows by range refinement.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation state. Here a
pass cuts the range of values into ``BUCKETS`` equal parts and takes count, least and greatest value of each;
the parts that hold a wanted rank are cut again in the next pass, until a part holds one value only.
A pass moves at most ``BUCKETS`` rows per wanted rank, and each one narrows the number of values by about
that factor: a billion distinct doubles take three or four passes over one written column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import materialize

BUCKETS = 1024


def order_statistics(values: DataFrame, ranks: Sequence[int], buckets: int = BUCKETS) -> dict[int, float]:
    """Values at 0-based ``ranks`` of the one double column ``v`` (no nulls, no NaN)."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    todo, known = [(low, high, 0, sorted(set(ranks)))], {}
    while todo:
        known.update({r: lo for lo, hi, _, want in todo if lo == hi for r in want})
        todo = [x for x in todo if x[0] < x[1]]
        if not todo:
            break
        part = F.lit(None).cast("int")
        bucket = F.lit(None).cast("double")
        for i, (lo, hi, _, _) in enumerate(todo):  # disjoint ranges; halves, so that no difference overflows
            inside = F.col("v").between(lo, hi)
            part = F.when(inside, i).otherwise(part)
            bucket = F.when(inside, F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * buckets)).otherwise(bucket)
        cut = values.select("v", part.alias("part"), F.least(bucket, F.lit(buckets - 1)).alias("bucket")).where("part IS NOT NULL")
        rows = cut.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        new = []
        for i, (_, _, before, want) in enumerate(todo):
            for r in sorted((r for r in rows if r["part"] == i), key=lambda r: r["bucket"]):
                mine = [k for k in want if before <= k < before + r["n"]]
                if mine:
                    new.append((r["lo"], r["hi"], before, mine))
                before += r["n"]
        todo = new
    return known


def quantile_values(df: DataFrame, col: str, qs: Sequence[float], buckets: int = BUCKETS) -> list[float | None]:
    """Linearly interpolated quantiles of ``col``; nulls and NaN are left out, and without any value there is none."""
    v = F.col(col).cast("double")
    values = materialize(df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v)))
    n = values.count()
    if not n:
        return [None] * len(qs)
    at = [q * (n - 1) for q in qs]
    known = order_statistics(values, [r for h in at for r in (math.floor(h), math.ceil(h))], buckets)
    return [known[math.floor(h)] + (known[math.ceil(h)] - known[math.floor(h)]) * (h - math.floor(h)) for h in at]


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float]) -> DataFrame:
    """``q, value``: a row per wanted quantile."""
    rows = [(float(q), v) for q, v in zip(qs, quantile_values(df, col, qs))]
    return df.sparkSession.createDataFrame(rows, "q double, value double")
