"""Row filters of the prepare stage (length, tokens, modality, labels, actors)."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import token_count


def with_tokens(df: DataFrame, tokenizer: str = "split", text_col: str = "text",
                out_col: str = "tokens") -> DataFrame:
    return df.withColumn(out_col, token_count(text_col, tokenizer).cast("bigint"))


def filter_min_chars(df: DataFrame, min_chars: int | None, text_col: str = "text") -> DataFrame:
    """Drop rows whose text has fewer than ``min_chars`` code points."""
    if not min_chars:
        return df
    return df.where(F.length(text_col) >= int(min_chars))


def filter_max_tokens(df: DataFrame, max_tokens: int | None, tokens_col: str = "tokens") -> DataFrame:
    """Drop rows with more than ``max_tokens`` tokens; ``None`` disables the filter."""
    if max_tokens is None:
        return df
    return df.where(F.col(tokens_col) <= int(max_tokens))


def modality_counts(df: DataFrame, modality_col: str = "modality") -> DataFrame:
    """Modality histogram, taken *before* the modality filter (after length/tokens)."""
    return df.groupBy(modality_col).agg(F.count(F.lit(1)).alias("n_docs"))


def filter_modality(df: DataFrame, modality: str | None, modality_col: str = "modality") -> DataFrame:
    if not modality:
        return df
    return df.where(F.col(modality_col) == modality)


def drop_unlabelled(df: DataFrame, label_col: str = "label") -> DataFrame:
    """No label, or an empty one, drops the row."""
    return df.where(F.col(label_col).isNotNull() & (F.col(label_col) != ""))


def actor_include(df: DataFrame, include: Iterable[str], actor_col: str = "actor") -> DataFrame:
    """Keep rows whose actor is in the (driver-side, small) include list."""
    include = list(include or [])
    if not include:
        return df
    return df.where(F.col(actor_col).isin(include))


def min_docs_per_group(df: DataFrame, group_col: str, min_docs: int) -> DataFrame:
    """Keep rows whose group has at least ``min_docs`` rows (a null key is a group).

    Counted by a partial (map-side combined) aggregation, then a null-safe
    left-semi join against the qualifying keys: a hot key is pre-aggregated,
    never gathered into one window partition.
    """
    if not min_docs or min_docs <= 0:
        return df
    ok = (df.groupBy(group_col).agg(F.count(F.lit(1)).alias("__n"))
          .where(F.col("__n") >= int(min_docs)).select(F.col(group_col).alias("__g")))
    return df.join(ok, df[group_col].eqNullSafe(ok["__g"]), "left_semi")
