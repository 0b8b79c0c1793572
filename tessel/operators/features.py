"""TF-IDF as relational operators (SQL-checkable), plus the sparse-vector
form used by Spark ML.

``doc_terms`` explodes each document into ``(id, term, tf)`` (1..n-grams of
lower-cased word tokens); ``fit_vocabulary`` keeps terms with document
frequency >= ``min_df`` (clamped to the number of documents), then the top
``max_features`` by corpus frequency (ties by term), with smooth idf
``ln((1+n)/(1+df)) + 1``; ``tfidf`` weights ``tf * idf`` and L2-normalises per
document. With ``max_features`` the vocabulary has a proven bound and is broadcast into
the term join; without it every term counts and the join is by key. Term ids are unique
numbers from a distributed rank, not positions in a sorted vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import word_ngrams, word_tokens
from tessel.plans.rank import bucketed_rank, top_k
from tessel.session import materialize, written


#: Characters of text to a partition while its terms are counted.
PART_CHARS = 4_000_000


def doc_terms(df: DataFrame, id_col: str = "id", text_col: str = "text", n_max: int = 2) -> DataFrame:
    # Cluster documents by id before exploding: the (id, term) aggregation is
    # then local (hash partitioning on id satisfies it), so the text moves once
    # instead of the much larger exploded n-gram rows. Tokens get their own
    # projection (see functions.text.shingles).
    # Its hash table holds the distinct terms of a partition, so partitions get some MB of text each however large the input is.
    chars = F.col("text_len") if text_col == "text" and "text_len" in df.columns else F.length(text_col)
    parts = 1 + int(df.agg(F.sum(chars)).first()[0] or 0) // PART_CHARS
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    d = d.repartition(max(parts, min(df.sparkSession.sparkContext.defaultParallelism, 1 + parts * 4)), "id")
    t = d.select("id", word_tokens("__text").alias("__tok"))
    return (t.select("id", F.explode(word_ngrams("__tok", n_max)).alias("term"))
            .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))


def fit_vocabulary(terms: DataFrame, n_docs, min_df: int = 5, max_features: int | None = 50000) -> DataFrame:
    """``(term, df, ctf, idf, term_id)``; ``n_docs`` is a Column (e.g. a scalar subquery)."""
    stats = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    eff_min = F.least(F.lit(int(min_df)), F.greatest(F.lit(1), n_docs))
    # candidates are read several times by the cut (histogram, cut value, ties): write them once
    v = written(stats.where(F.col("df") >= eff_min), "candidates")
    if max_features:
        v = top_k(v, "ctf", "term", int(max_features))
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    v = v.withColumn("idf", idf).withColumn("__h", F.md5("term"))
    return bucketed_rank(v, [], "__h", "term", rank_col="term_id", n_col=None).withColumn("term_id", F.col("term_id").cast("int")).drop("__h")


def tfidf(terms: DataFrame, vocab: DataFrame, max_features: int | None = 50000) -> DataFrame:
    """``(id, term, term_id, df, w)`` with ``w`` L2-normalised per document.
    The vocabulary is broadcast only when ``max_features`` bounds its size."""
    v = vocab.select("term", "term_id", "df", "idf")
    if max_features:
        v = F.broadcast(v)
    x = terms.join(v, "term").withColumn("__w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy("id")))
    return x.select("id", "term", "term_id", "df", (F.col("__w") / norm).alias("w"))


def tfidf_pipeline(df: DataFrame, id_col: str = "id", text_col: str = "text", min_df: int = 5,
                   max_features: int | None = 50000, n_max: int = 2):
    """Fit on ``df`` and transform it; returns ``(vectors, vocab)``."""
    # the term table is the expensive core (one row per document x term):
    # write it once, then statistics, the vocabulary cut and weights read it
    terms = written(doc_terms(df, id_col, text_col, n_max), "terms")
    n_docs = terms.select(F.count_distinct("id")).scalar()
    vocab = materialize(fit_vocabulary(terms, n_docs, min_df, max_features))
    return tfidf(terms, vocab, max_features), vocab


def tfidf_counts(df: DataFrame, id_col: str = "id", text_col: str = "text", min_df: int = 5, max_features: int = 50000, n_max: int = 2):
    """``(counts, vocab, weights)`` of the same vectors as :func:`tfidf_pipeline`, for a bounded vocabulary: ``counts`` (written) is a row
    per document ``(id, t, tf)``, the ids of its vocabulary terms ascending and how often it has them; ``weights`` is a broadcast of the
    document frequency and the idf by term id.

    A document's terms are written as one row, in the partition where they are counted, so they meet the vocabulary
    without a shuffle of rows (document, term)."""
    spark = df.sparkSession
    rows = doc_terms(df, id_col, text_col, n_max).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf")))).alias("x"))  # sorted terms compress better
    lists = written(rows.select("id", "x.term", "x.tf"), "terms", compression="zstd")
    n_docs = lists.select(F.count("id")).scalar()
    terms = lists.select(F.explode(F.arrays_zip("term", "tf")).alias("x")).select("x.term", "x.tf")
    vocab = materialize(fit_vocabulary(terms, n_docs, min_df, max_features))
    words = vocab.orderBy("term_id").select("term_id", "term", "df", "idf").toArrow().combine_chunks()  # max_features rows at most
    number, freq, idf = (words[c].to_numpy() for c in ("term_id", "df", "idf"))
    by_id = np.zeros(int(number.max(initial=-1)) + 1, np.int64), np.zeros(int(number.max(initial=-1)) + 1)
    by_id[0][number], by_id[1][number] = freq, idf
    known = spark.sparkContext.broadcast((words["term"].combine_chunks().cast(pa.string()), number.astype(np.int32)))

    def run(batches):
        terms, number = known.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                size = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                at = pc.fill_null(pc.index_in(batch.column(1).flatten().cast(pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False)
                owner, tf = np.repeat(np.arange(len(size)), size)[at >= 0], batch.column(2).flatten().to_numpy(zero_copy_only=False)[at >= 0]
                t = number[at[at >= 0]]
                order = np.lexsort((t, owner))
                n = np.bincount(owner, minlength=len(size))
                some = np.flatnonzero(n)  # a document without any vocabulary term has no vector
                starts = pa.array(np.concatenate([[0], np.cumsum(n[some])]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(starts, pa.array(t[order], pa.int32())),
                                                  pa.ListArray.from_arrays(starts, pa.array(tf[order], pa.int32()))], names=["id", "t", "tf"])

    kind = lists.schema["id"].dataType.simpleString()
    return written(lists.mapInArrow(run, f"id {kind}, t array<int>, tf array<int>"), "counts"), vocab, spark.sparkContext.broadcast(by_id)


def chi2_terms(vectors: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """``term, chi2``: each term's chi-square statistic against the label, from one aggregation of its weights by class;
    the ``k`` best (ties by term), or all. ``labels`` has one row per ``id`` with a ``label``.

    With observed class sums o and expected ones e = share of the class * sum of the term,
    the sum of (o - e)^2 / e over all classes is the sum of o^2 / e less the term's sum."""
    share = labels.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    share = share.join(F.broadcast(share.agg(F.sum("c").alias("n")))).select("label", (F.col("c") / F.col("n")).alias("p"))  # one row per class
    seen = vectors.join(labels.select("id", "label"), "id").groupBy("term", "label").agg(F.sum("w").alias("o"))
    x = seen.join(F.broadcast(share), "label").groupBy("term").agg(F.sum("o").alias("s"), F.sum(F.col("o") * F.col("o") / F.col("p")).alias("q"))
    x = x.select("term", F.round(F.greatest(F.col("q") / F.col("s") - F.col("s"), F.lit(0.0)), 6).alias("chi2"))
    return top_k(materialize(x), "chi2", "term", int(k)) if k else x
