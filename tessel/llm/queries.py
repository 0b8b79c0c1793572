"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import chat_quotes, chat_repair, chat_repair_sql, collocations, embed_dedup, lang_id, licenses, line_dedup, minhash_dedup, mixing, packing, quality, secrets, topk
from tessel.llm.common import read_table
from tessel.llm.registry import ORACLE, QUERIES, query  # noqa: F401


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


@query("op5_mixing", mixing.sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(read_table(spark, sf_dir, "documents")).drop("doc", "h")


#: Components of an edge list e(a, b) over nodes n(id), smallest reachable id.
_REACH = """both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, c) AS (SELECT id, id FROM n UNION SELECT both_.b, reach.c FROM reach JOIN both_ ON reach.id = both_.a),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

OP6_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.93),
e AS (SELECT a, b FROM p), n AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT t.vec_id, (SELECT count(*) FROM both_ WHERE both_.a = t.vec_id) AS n_links, comp.component_id, t.vec_id = comp.component_id AS kept
FROM embeddings t JOIN comp ON comp.id = t.vec_id"""

OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
n AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM documents d LEFT JOIN z USING (doc_id) JOIN comp ON comp.id = d.doc_id"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


@query("op6_embedding_near_dup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op7_minhash", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


@query("op8_chat_quotes", chat_quotes.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.format_chats(read_table(spark, sf_dir, "conversations"))


@query("op9_exact_top_k", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k_search(vectors, topk.multiples_as_queries(vectors), k=10)


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def id_fold(folds: int):
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.fit(docs.where(id_fold(4) != 2))
    out = lang_id.main_language(lang_id.language_spans(docs.select("doc_id", "text"), model))
    return out.select("doc_id", F.coalesce(id_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels.where(id_fold(5) != 0), cut=0.3)
    return quality.score(docs, model, "score").select(
        "doc_id", F.coalesce(id_fold(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_license_scan")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query("op12_collocations", collocations.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


@query("op13_chat_repair", chat_repair_sql.sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(read_table(spark, sf_dir, "conversations"))
