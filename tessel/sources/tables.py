"""Driver tables and the labelled-document view built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def read_table(spark: SparkSession, sf_dir: str, name: str, row_id: bool = False) -> DataFrame:
    """One parquet table; column pruning and filters reach the scan. Text
    tables are spread over at least ``defaultParallelism`` tasks. ``row_id`` adds
    ``rid``, a key unique per row and the same in every scan: file and position in it."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if row_id:
        df = df.select("*", F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string")).alias("rid"))
    if name in TEXT_TABLES:
        df = spread(df, TEXT_TABLES[name])
    return df


# How a driver label column becomes a string class label.
LABEL_VIEWS = {
    "quality": ("good", "bad"),
    "toxic": ("toxic", "clean"),
}


def label_expr(view: str):
    pos, neg = LABEL_VIEWS[view]
    return F.when(F.col(view) == 1, pos).when(F.col(view) == 0, neg)


def document_rows(spark: SparkSession, sf_dir: str, with_text: bool = True, row_id: bool = False) -> DataFrame:
    """``documents`` as prepare-stage rows without a label: ``id``, ``text``, ``modality``
    (= lang), ``source`` (the per-row source field), ``label_raw`` (= source), and ``rid``."""
    docs = read_table(spark, sf_dir, "documents", row_id)
    return docs.select(F.col("doc_id").alias("id"), *(["text"] if with_text else []), F.col("lang").alias("modality"), "source",
                       F.col("source").alias("label_raw"), *(["rid"] if row_id else []))


def attach_labels(rows: DataFrame, spark: SparkSession, sf_dir: str, label_view: str = "quality") -> DataFrame:
    """Add ``label`` (null when the document carries none; the unlabelled filter drops it later)."""
    if label_view == "lang":
        return rows.withColumn("label", F.col("modality"))
    labels = read_table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max(label_view).alias(label_view))
    return rows.join(labels.select("id", label_expr(label_view).alias("label")), "id", "left")  # one label row per id: rows never multiply


def labelled_docs(spark: SparkSession, sf_dir: str, label_view: str = "quality",
                  with_text: bool = True) -> DataFrame:
    """The document row with its label: ``documents`` ⟕ ``labels``.
    ``label_view='lang'`` gives a four-class label without the labels table."""
    return attach_labels(document_rows(spark, sf_dir, with_text), spark, sf_dir, label_view)


def actor_docs(spark: SparkSession, sf_dir: str, label_view: str = "quality") -> DataFrame:
    """Labelled documents with the actor fields of the ideology view: ``crawl``
    (one crawl per source and language, ``<source>-<lang>``) and ``domain``
    (a site domain, present for fr/de documents only, so that resolution
    falls back to the crawl for the others)."""
    d = labelled_docs(spark, sf_dir, label_view)
    return (d.withColumn("crawl", F.concat_ws("-", "source", "modality"))
            .withColumn("domain", F.when(F.col("modality").isin("fr", "de"),
                                         F.concat_ws(".", "source", "modality", F.lit("example.org")))))
