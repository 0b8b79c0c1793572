"""Deterministic hash keys.

Everything "random" in the pipeline (split, caps, sampling, oversampling,
label shuffles) is ordered by ``md5(seed || ':' || id)``: reproducible across
runs, independent of partitioning, and computable identically in SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["order_key", "MERSENNE31"]

MERSENNE31 = 2147483647  # 2^31 - 1, modulus of the MinHash family


def order_key(id_col, seed, *extra) -> Column:
    """``md5(seed:id[:extra...])`` as a 32-char hex string."""
    parts = [F.lit(str(seed)), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")]
    parts += [F.lit(str(e)) if not isinstance(e, Column) else e.cast("string") for e in extra]
    return F.md5(F.concat_ws(":", *parts))

