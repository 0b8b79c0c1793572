"""Registered queries: TSV round trip, sharded export, header-text length
filter, balance dispatch inside the prepare stage, run-override merging."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessel.plans import sql as Q
from tessel.plans.catalog_balance import CAP, CAP_TOKENS, H, TRAIN
from tessel.plans.catalog_tei import _CLEAN, _scan_docs
from tessel.plans.prepare import PrepareParams, prepare
from tessel.plans.registry import query
from tessel.session import scratch_path
from tessel.sources import tsv as TSV
from tessel.sources.tables import read_table

PREP = Q.prepared()


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("tsv_roundtrip", f"WITH {PREP} SELECT CAST(id AS VARCHAR) AS id, label, label_raw, modality, source, md5(text) AS text_md5 FROM v")
def q_tsv_roundtrip(spark, sf):
    path = TSV.write_view_tsv(prepare(spark, sf), _scratch(spark, "view-tsv"))
    back = TSV.read_labelled_tsv(spark, path)
    return back.select("id", "label", "label_raw", "modality", "source", F.md5("text").alias("text_md5"))


@query("shard_export")
def q_shard_export(spark, sf):
    """Shards of at most 50 rows: per shard file, its row count (rows-only:
    the number of files depends on the partitioning)."""
    path = TSV.write_shards(prepare(spark, sf).where("split = 'train'"), _scratch(spark, "shards"), 50)
    back = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("shard"))
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


@query("shard_totals", f"WITH {PREP} SELECT count(*) AS n_rows, true AS within_size FROM v WHERE split = 'train'")
def q_shard_totals(spark, sf):
    """What holds however the rows are dealt: all rows, none of the shards above the size."""
    return q_shard_export(spark, sf).agg(F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= 50).alias("within_size"))


@query("shard_export_exact", f"""WITH {PREP}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v WHERE split = 'train')
SELECT printf('train_%03d', k // 50) AS shard, count(*) AS n_rows, min(id) AS first_id, max(id) AS last_id, 1::BIGINT AS n_files FROM n GROUP BY 1""")
def q_shard_export_exact(spark, sf):
    """Numbered shards of exactly 50 rows, read back."""
    v = prepare(spark, sf).where("split = 'train'")
    path = TSV.write_exact_shards(v, _scratch(spark, "shards-exact"), 50, "id", ["id"])
    back = spark.read.parquet(path).select("shard", "id", F.col("_metadata.file_name").alias("f"))
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
                                     F.count_distinct("f").alias("n_files")).withColumn("shard", F.col("shard").cast("string"))


@query("tei_text_len_filter", f"""SELECT 'd' || doc_id AS id, CAST(length(replace({_CLEAN}, chr(10), '')) AS BIGINT) AS head_p_len
FROM documents WHERE length(replace({_CLEAN}, chr(10), '')) >= 300""")
def q_tei_len_filter(spark, sf):
    s = _scan_docs(spark, sf)
    return s.where(F.col("head_p_len") >= 300).select("id", F.col("head_p_len").cast("bigint").alias("head_p_len"))


@query("prepare_cap_docs", f"""WITH {PREP}, {TRAIN},
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}, id) AS r FROM tr)
SELECT CAST(id AS VARCHAR) AS id, label, split FROM rk WHERE r <= {CAP}
UNION ALL SELECT CAST(id AS VARCHAR), label, split FROM v WHERE split = 'job'""")
def q_prepare_cap_docs(spark, sf):
    return prepare(spark, sf, PrepareParams(balance="cap_docs", cap=CAP)).select("id", "label", "split")


@query("prepare_cap_tokens", f"""WITH {PREP}, {TRAIN},
r AS (SELECT id, label, split, row_number() OVER w AS r,
             coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
             sum(tokens) OVER (PARTITION BY label) AS tt
      FROM tr WINDOW w AS (PARTITION BY label ORDER BY {H}, id))
SELECT CAST(id AS VARCHAR) AS id, label, split FROM r WHERE pre < {CAP_TOKENS}
UNION ALL SELECT CAST(id AS VARCHAR) || '#dup' || CAST(r AS VARCHAR), label, split FROM r WHERE tt < {CAP_TOKENS} AND tt + pre < {CAP_TOKENS}
UNION ALL SELECT CAST(id AS VARCHAR), label, split FROM v WHERE split = 'job'""")
def q_prepare_cap_tokens(spark, sf):
    return prepare(spark, sf, PrepareParams(balance="cap_tokens", cap_tokens=CAP_TOKENS)).select("id", "label", "split")


# Fixed base overrides of every run; axis overrides come from the data (one run per corpus language).
BASE_OVERRIDES = {"seed": "42", "train_prop": "0.8", "balance": "none", "model": "tfidf_svm_quick"}


@query("run_overrides", f"""WITH runs AS (SELECT DISTINCT lang AS corpus FROM documents),
base(k, v) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in BASE_OVERRIDES.items())}),
axis AS (SELECT corpus, 'corpus' AS k, corpus AS v FROM runs UNION ALL SELECT corpus, 'train_prop', '0.5' FROM runs),
m AS (SELECT runs.corpus, base.k, base.v FROM runs, base WHERE base.k NOT IN (SELECT k FROM axis a WHERE a.corpus = runs.corpus)
      UNION ALL SELECT corpus, k, v FROM axis)
SELECT corpus, k AS key, v AS value FROM m""")
def q_run_overrides(spark, sf):
    from tessel.operators.experiments import merge_maps
    runs = read_table(spark, sf, "documents").select(F.col("lang").alias("corpus")).distinct()
    base = F.create_map(*[x for k, v in BASE_OVERRIDES.items() for x in (F.lit(k), F.lit(v))])
    axis = F.create_map(F.lit("corpus"), F.col("corpus"), F.lit("train_prop"), F.lit("0.5"))
    m = runs.select("corpus", merge_maps(base, axis).alias("o"))
    return m.select("corpus", F.explode("o").alias("key", "value"))
