"""Training-data pipeline over ``documents``: five stages, each over all that its
predecessor kept, written as Parquet and read again in between.

1. ``quality``: the Bradley-Terry classifier of ``labels.quality``; rejected documents go.
2. ``line_dedup``: blocks of lines that an earlier document has are deleted; a document
   of which nothing is left goes.
3. ``near_dedup``: five-word MinHash groups at similarity 0.8; the member with the
   smallest doc_id stays (one row of it, if the row is repeated). Documents without words have no
   group and stay.
4. ``mixing``: whole documents at the target weights, up to two epochs each; a document taken
   twice is two rows.
5. ``packing``: sequences of 2,048 tokens; one row per piece.

Stages 1 to 4 return the columns of ``documents``; ``n_chars`` follows a changed text.
SQL cannot express stages 1, 2, 3 and 5, so there is no ORACLE_SQL; tests hold each
stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import line_dedup, minhash_dedup, mixing, packing, quality
from tessel.llm.common import free, read_table, stored
from tessel.llm.queries import tokenizer_path

REJECT_BELOW = 0.3
#: The mix takes this share of the words that reach it.
BUDGET_PERCENT = 90


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels, cut=REJECT_BELOW)
    score, = free(docs, "quality")
    return quality.score(docs, model, score).where(F.col(score) >= REJECT_BELOW).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, deleted = free(docs, "n_lines", "n_deleted")
    out = line_dedup.dedup_lines(docs, lines_col=lines, deleted_col=deleted)
    changed = F.col(deleted) > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.where(~changed | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.one_of_each(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, budget_percent=BUDGET_PERCENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("line_dedup", drop_shared_lines), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
