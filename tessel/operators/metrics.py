"""Classification metrics from one confusion aggregation, and relational baselines.

``confusion`` is the only pass over the rows: ``(group..., y_true, y_pred) ->
count``. Every metric (accuracy, per-label precision/recall/F1/support,
macro and weighted averages, per-group versions) is derived from that small
table, so no row ever reaches the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MISSING = "__missing__"
# Marks of a row without a label or a prediction.
NO_LABEL, NO_PRED = "__NO_LABEL__", "__NO_PRED__"


def argmax_label(scores, mark: str):
    """The label of the highest score in a ``map<string,double>``, the first one in the map at ties; ``mark`` where there is
    no map, no entry or no score."""
    entries = F.filter(F.map_entries(scores), lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]))
    first = F.aggregate(entries, F.struct(F.lit(None).cast("string").alias("k"), F.lit(None).cast("double").alias("v")),
                        lambda a, e: F.when(a["v"].isNull() | (e["value"] > a["v"]), F.struct(e["key"].alias("k"), e["value"].alias("v"))).otherwise(a))
    return F.coalesce(first["k"], F.lit(mark))


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
              keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    return (df.select(*keys, F.coalesce(F.col(y_true).cast("string"), F.lit(NO_LABEL)).alias("y_true"),
                      F.coalesce(F.col(y_pred).cast("string"), F.lit(NO_PRED)).alias("y_pred"))
            .groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("cnt")))


def report_from_confusion(conf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long-form report per ``keys``: one row per label of ``y_true ∪ y_pred``,
    plus ``accuracy``, ``macro avg``, ``weighted avg`` rows. 0/0 -> 0.

    A linear chain over the (small) confusion table, no self-joins: each cell
    contributes to its true label and to its predicted label (one explode),
    one aggregation gives per-label counts, and one fold per key builds the
    label rows and the three summary rows, which ``inline`` turns back into
    rows. The per-key fold holds one entry per class label.
    """
    keys = list(keys)
    contrib = F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("cnt").alias("n_true"), F.lit(0).cast("bigint").alias("n_pred"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("cnt")).otherwise(0).cast("bigint").alias("tp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("n_true"), F.col("cnt").alias("n_pred"),
                 F.lit(0).cast("bigint").alias("tp"))))
    per = (conf.select(*keys, contrib.alias("c")).select(*keys, "c.*")
           .groupBy(*keys, "label").agg(F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"),
                                        F.sum("tp").alias("tp")))
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    f1 = F.when(F.col("n_true") + F.col("n_pred") > 0,
                2.0 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))).otherwise(0.0)
    per = per.select(*keys, "label", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                     F.col("n_true").alias("support"), "tp")
    row = F.struct("label", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"))
    g = per.groupBy(*keys).agg(
        F.collect_list(row).alias("rows"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum("support").alias("N"), F.sum("tp").alias("TP"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    safe = F.when(F.col("N") > 0, F.col("N"))
    acc = F.coalesce(F.col("TP") / safe, F.lit(0.0))
    n = F.col("N").cast("bigint")

    def srow(name, p_, r_, f_):
        return F.struct(F.lit(name).alias("label"), p_.alias("precision"), r_.alias("recall"),
                        f_.alias("f1"), n.alias("support"))
    summ = F.array(
        srow("accuracy", acc, acc, acc),
        srow("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        srow("weighted avg", F.coalesce(F.col("wp") / safe, F.lit(0.0)),
             F.coalesce(F.col("wr") / safe, F.lit(0.0)), F.coalesce(F.col("wf") / safe, F.lit(0.0))))
    out = g.select(*keys, F.inline(F.concat(F.col("rows"), summ)))
    return out.select(*keys, "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                          keys: Sequence[str] = ()) -> DataFrame:
    return report_from_confusion(confusion(df, y_true, y_pred, keys), keys)


def summary_metrics(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``accuracy`` and ``macro_f1`` (one row per ``keys``) from a long report."""
    keys = list(keys)
    return report.groupBy(*keys).agg(
        F.max(F.when(F.col("label") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("label") == "macro avg", F.col("f1"))).alias("macro_f1"),
        F.max(F.when(F.col("label") == "macro avg", F.col("precision"))).alias("precision_macro"),
        F.max(F.when(F.col("label") == "macro avg", F.col("recall"))).alias("recall_macro"),
        F.max(F.when(F.col("label") == "accuracy", F.col("support"))).alias("n_eval"))


def metrics_by_group(df: DataFrame, fields: Sequence[str], y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """Per-group reports for several group fields at once.

    One ``GROUPING SETS ((f1), (f2), ...)`` aggregation builds the confusion
    counts of every field; null values are first coalesced to ``__missing__``
    so they form their own group and ``grouping(f)`` tells the sets apart.
    """
    fields = list(fields)
    d = df.select(*[F.coalesce(F.col(f).cast("string"), F.lit(MISSING)).alias(f) for f in fields],
                  F.coalesce(F.col(y_true).cast("string"), F.lit(NO_LABEL)).alias("y_true"),
                  F.coalesce(F.col(y_pred).cast("string"), F.lit(NO_PRED)).alias("y_pred"))
    g = d.groupingSets([[f, "y_true", "y_pred"] for f in fields], *fields, "y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("cnt"), *[F.grouping(f).alias(f"__g{i}") for i, f in enumerate(fields)])
    field_name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, f in enumerate(fields):  # each grouping set holds exactly one field
        present = F.col(f"__g{i}") == 0
        field_name = F.when(present, F.lit(f)).otherwise(field_name)
        value = F.when(present, F.col(f)).otherwise(value)
    conf = g.select(field_name.alias("group_field"), value.alias("group_value"), "y_true", "y_pred", "cnt")
    return report_from_confusion(conf, ["group_field", "group_value"])


def majority_label(train: DataFrame, label_col: str = "label") -> DataFrame:
    """One-row frame ``majority``: the most frequent label (ties -> smallest label).
    A top-1 over the per-label count table, never over rows."""
    c = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("c"))
    return c.orderBy(F.desc("c"), F.asc(label_col)).limit(1).select(F.col(label_col).alias("majority"))


def baseline_majority(df: DataFrame, split_col: str = "split", label_col: str = "label") -> DataFrame:
    """Always-majority predictor: the train mode (a scalar subquery) predicted
    for every job row."""
    maj = majority_label(df.where(F.col(split_col) == "train"), label_col).scalar()
    job = df.where(F.col(split_col) == "job")
    return job.select(F.col(label_col).alias("y_true"), maj.alias("y_pred"))


def source_majority_predictions(df: DataFrame, source_col: str = "source", split_col: str = "split",
                                label_col: str = "label", id_col: str = "id") -> DataFrame:
    """Source-majority predictor: each source predicts its most frequent train
    label (ties -> smallest label); unseen sources get the global majority.

    Rows are reduced to a ``(source, label) -> count`` table first; the rank
    runs over that small table, and it is joined back by key (AQE picks the
    strategy after measuring it).
    """
    train = df.where(F.col(split_col) == "train")
    per = train.groupBy(source_col, label_col).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(source_col).orderBy(F.desc("c"), F.asc(label_col))
    best = (per.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
            .select(F.col(source_col).alias("__s"), F.col(label_col).alias("__src_maj")))
    maj = majority_label(train, label_col).scalar()
    job = df.where(F.col(split_col) == "job")
    j = job.join(best, job[source_col] == best["__s"], "left")
    return j.select(F.col(id_col), F.col(source_col), F.col(label_col).alias("y_true"),
                    F.coalesce(F.col("__src_maj"), maj).alias("y_pred"))


def quality_flags(summary: DataFrame, min_accuracy: float = 0.6, min_macro_f1: float = 0.5,
                  family_col: str | None = None, families: Sequence[str] | None = None,
                  status_col: str | None = None) -> DataFrame:
    """``quality_ok`` and ``quality_flags`` (``low_accuracy,low_macro_f1``) of successful runs of the given
    families; null for runs that are not judged. A missing metric counts as 0."""
    applies = F.lit(True)
    if family_col and families:
        applies = applies & F.coalesce(F.col(family_col).isin(list(families)), F.lit(False))
    if status_col:
        applies = applies & F.coalesce(F.col(status_col) == "success", F.lit(False))
    low = lambda c, least, name: F.when(F.coalesce(F.col(c), F.lit(0.0)) < float(least), F.lit(name))
    flags = F.array_compact(F.array(low("accuracy", min_accuracy, "low_accuracy"), low("macro_f1", min_macro_f1, "low_macro_f1")))
    return (summary.withColumn("quality_ok", F.when(applies, F.size(flags) == 0))
            .withColumn("quality_flags", F.when(applies, F.array_join(flags, ","))))
