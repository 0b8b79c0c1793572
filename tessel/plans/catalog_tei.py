"""Registered queries: TEI export/scan round trips, header and term extraction,
corpus defaults, multi-corpus union, and the train/job sink."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tessel.plans import sql as Q
from tessel.plans.prepare import PrepareParams, prepare, prepare_frame
from tessel.plans.rank import first_n
from tessel.plans.registry import query
from tessel.session import scratch_path
from tessel.sources import tei as TEI
from tessel.sources.tables import read_table

_CLEAN = r"regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
BODY = f"array_to_string(list_filter(list_transform(string_split({_CLEAN}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')"


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _doc_corpus(spark, sf) -> str:
    """Write the documents table as a TEI corpus (English documents carry a
    modality term) and return its path."""
    d = read_table(spark, sf, "documents")
    d = d.withColumn("modality_term", F.when(F.col("lang") == "en", F.lit("web")))
    rec = TEI.tei_records(d, "doc_id", "text", "lang", "source", "modality_term", "n_chars")
    return TEI.write_tei(rec, _scratch(spark, "tei-documents"))


def _scan_docs(spark, sf, default=None):
    return TEI.scan_tei(spark, _doc_corpus(spark, sf), "documents", default)


@query("tei_scan", f"""SELECT 'd' || doc_id AS id, CASE WHEN lang = 'en' THEN 'web' ELSE 'unknown' END AS modality,
  md5({BODY}) AS text_md5, CAST(length({BODY}) AS BIGINT) AS text_len, false AS corrupt FROM documents""")
def q_tei_scan(spark, sf):
    s = _scan_docs(spark, sf)
    return s.select("id", "modality", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("text_len"),
                    F.col("_corrupt").alias("corrupt"))


@query("header_fields", """SELECT 'd' || doc_id AS id, 'http://' || source || '.example.org/' || doc_id AS url,
  md5(text) AS md5_text, CAST(n_chars AS BIGINT) AS chars, lang AS langs FROM documents""")
def q_header_fields(spark, sf):
    s = _scan_docs(spark, sf)
    return s.select("id", "url", "md5_text", F.col("chars").cast("bigint").alias("chars"),
                    F.array_join("langs", ",").alias("langs"))


@query("term_extract", """SELECT 'd' || doc_id AS id, source || '.example.org' AS domain, source || '-' || lang AS crawl,
  CASE WHEN lang = 'en' THEN 'web' END AS modality_term, CAST(NULL AS VARCHAR) AS blank_term FROM documents""")
def q_term_extract(spark, sf):
    s = _scan_docs(spark, sf)
    return s.select("id", TEI.term("terms", "domain").alias("domain"), TEI.term("terms", "crawl").alias("crawl"),
                    TEI.term("terms", "modality").alias("modality_term"), TEI.term("terms", "blank").alias("blank_term"))


@query("modality_default", "SELECT 'd' || doc_id AS id, CASE WHEN lang = 'en' THEN 'web' ELSE 'press' END AS modality FROM documents")
def q_modality_default(spark, sf):
    return _scan_docs(spark, sf, default="press").select("id", "modality")


@query("multi_corpus_union", f"""SELECT 'documents' AS corpus_id, 'd' || doc_id AS id,
  CASE WHEN lang = 'en' THEN 'web' ELSE 'press' END AS modality, CAST(length({BODY}) AS BIGINT) AS text_len FROM documents
UNION ALL SELECT 'conversations', 'd' || conv_id || '_' || turn, 'dialogue', CAST(length({BODY}) AS BIGINT) FROM conversations""")
def q_multi_corpus_union(spark, sf):
    conv = read_table(spark, sf, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("cid"), "text", F.lit("xx").alias("lang"),
        F.col("role").alias("source"))
    conv_path = TEI.write_tei(TEI.tei_records(conv, "cid", "text", "lang", "source"), _scratch(spark, "tei-conversations"))
    corpora = [(_doc_corpus(spark, sf), "documents", "press"), (conv_path, "conversations", "dialogue")]
    scans = [TEI.scan_tei(spark, p, cid, default) for p, cid, default in corpora]
    u = reduce(lambda a, b: a.unionByName(b), scans)
    return u.select("corpus_id", "id", "modality", F.length("text").cast("bigint").alias("text_len"))


@query("tei_roundtrip", f"SELECT 'd' || doc_id AS id, md5({BODY}) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_tei_roundtrip(spark, sf):
    """Filter a scanned corpus by an id list, write the kept records, and scan them back."""
    keep = read_table(spark, sf, "labels").select(F.concat(F.lit("d"), "doc_id"))
    out = TEI.export_kept(spark, _doc_corpus(spark, sf), keep, _scratch(spark, "tei-kept"))
    return TEI.scan_tei(spark, out).select("id", F.md5("text").alias("text_md5"))


@query("tei_prepare", f"""WITH d AS (SELECT 'd' || doc_id AS id, lang AS label, {BODY} AS text FROM documents)
SELECT label, count(*) AS n_docs, CAST(round_even(0.8::DOUBLE * count(*), 0) AS BIGINT) AS n_train FROM (
  SELECT * FROM d WHERE length(text) >= 200 QUALIFY row_number() OVER (PARTITION BY {Q.dedup_key()} ORDER BY id) = 1) GROUP BY label""")
def q_tei_prepare(spark, sf):
    """A scanned TEI corpus through the prepare stage."""
    s = _scan_docs(spark, sf).select("id", "text", "modality", F.get("langs", F.lit(0)).alias("label"), F.lit("documents").alias("source"))
    v = prepare_frame(s, PrepareParams(), with_text=False)
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("split") == "train", 1)).alias("n_train"))


@query("write_view", f"WITH {Q.prepared()} SELECT split, label, count(*) AS n_docs FROM v GROUP BY split, label")
def q_write_view(spark, sf):
    path = _scratch(spark, "view")
    prepare(spark, sf).select("id", "label", "label_raw", "modality", "source", "text", "split") \
        .write.mode("overwrite").partitionBy("split").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_docs"))


def _nameless_corpora(spark, sf):
    """The two corpora in the order of their ids over several files each; every third of the documents has no id."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lit("xx").alias("lang"), F.col("role").alias("source"))
    c = c.withColumn("cid", F.concat_ws("_", "conv_id", "turn"))
    out = []
    for df, order, ident, name in ((d, ["doc_id"], "doc_id", "documents"), (c, ["conv_id", "turn"], "cid", "conversations")):
        df = df.sort(*order)  # a range-partitioned sort: file after file in order
        rec = TEI.tei_records(df, ident, "text", "lang", "source")
        if name == "documents":
            key = F.regexp_extract("value", '^<TEI xml:id="d([0-9]+)"', 1).cast("bigint")
            rec = rec.select(F.when(key % 3 == 0, F.regexp_replace("value", '^<TEI xml:id="[^"]*"', "<TEI")).otherwise(F.col("value")).alias("value"))
        out.append((TEI.write_tei(rec, _scratch(spark, f"tei-order-{name}")), name, None))
    return out


_ORDER_SQL = f"""o AS (SELECT 'documents' AS corpus_id, CASE WHEN doc_id % 3 <> 0 THEN 'd' || doc_id END AS id, {BODY} AS body, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents
  UNION ALL SELECT 'conversations', 'd' || conv_id || '_' || turn, {BODY}, (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY conv_id, turn) FROM conversations),
n AS (SELECT corpus_id, coalesce(id, 'doc_' || ordinal) AS id, ordinal, body FROM o)"""


@query("tei_ordinals", f"WITH {_ORDER_SQL} SELECT corpus_id, id, ordinal, md5(body) AS text_md5 FROM n")
def q_tei_ordinals(spark, sf):
    """The running index of documents through two corpora, and the names it gives to documents without an id."""
    s = TEI.scan_in_order(spark, _nameless_corpora(spark, sf))
    return s.select("corpus_id", "id", "ordinal", F.md5("text").alias("text_md5"))


@query("max_docs_file_order", f"WITH {_ORDER_SQL} SELECT id, ordinal FROM n WHERE length(body) >= 200 ORDER BY ordinal LIMIT 700")
def q_max_docs_file_order(spark, sf):
    """The first 700 documents of 200 characters or more, in file order through both corpora."""
    s = TEI.scan_in_order(spark, _nameless_corpora(spark, sf)).where(F.length("text") >= 200)
    return first_n(s.select("ordinal", "id"), 700, ["ordinal"], "ordinal").select("id", "ordinal")
