"""Registered queries: sweep, run grid, runs ⟕ metrics, report, flags,
learning curves, typed metrics reload, metrics-file tree."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.operators import dedup as D
from tessel.operators import experiments as X
from tessel.operators.metrics import (NO_LABEL, NO_PRED, argmax_label, classification_report, majority_label, quality_flags,
                                      source_majority_predictions, summary_metrics)
from tessel.plans import sql as Q
from tessel.plans.prepare import PrepareParams, filtered_docs, prepare
from tessel.plans.registry import query
from tessel.session import materialize, scratch_path
from tessel.sources import runs as RF
from tessel.sources.tables import labelled_docs, read_table

PREP = Q.prepared()
H = Q.order_key("id")
CELLS = [{"train_prop": p, "balance": b, "cap": cap} for p in (0.5, 0.7, 0.8)
         for b, cap in (("none", 0), ("cap_docs", 100))]
CELLS.append({"train_prop": 0.0, "balance": "none", "cap": 0})  # nothing to train on: its runs fail
MODELS = ("majority", "source_majority")
CELLS_SQL = "cells(cell, p, balance, cap) AS (VALUES " + ", ".join(
    f"({i}, {c['train_prop']}, '{c['balance']}', {c['cap']})" for i, c in enumerate(CELLS)) + ")"
MODELS_SQL = "models(mi, model) AS (VALUES " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(MODELS)) + ")"

SWEEP = f"""{CELLS_SQL}, {MODELS_SQL},
rk AS (SELECT id, label, source, row_number() OVER (PARTITION BY label ORDER BY {H}, id) AS r, count(*) OVER (PARTITION BY label) AS n FROM dd),
x AS (SELECT rk.*, cells.cell, round_even(CAST(cells.p AS DOUBLE) * n, 0) AS ntr, cells.cap FROM rk, cells),
x2 AS (SELECT *, r <= CASE WHEN cap > 0 THEN least(ntr, cap) ELSE ntr END AS is_train, r > ntr AS is_job FROM x),
cnt_tr AS (SELECT cell, source, label, count(*) AS c FROM x2 WHERE is_train GROUP BY ALL),
smaj AS (SELECT cell, source, label AS smaj FROM cnt_tr QUALIFY row_number() OVER (PARTITION BY cell, source ORDER BY c DESC, label) = 1),
gmaj AS (SELECT cell, label AS gmaj FROM (SELECT cell, label, sum(c) AS c FROM cnt_tr GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY cell ORDER BY c DESC, label) = 1),
ntrain AS (SELECT cell, count(*) AS n_train FROM x2 WHERE is_train GROUP BY cell),
pred AS (SELECT x2.cell, m.model, x2.label AS y_true,
                CASE WHEN m.model = 'majority' THEN g.gmaj ELSE coalesce(s.smaj, g.gmaj) END AS y_pred
         FROM x2 LEFT JOIN smaj s ON s.cell = x2.cell AND s.source = x2.source LEFT JOIN gmaj g ON g.cell = x2.cell, models m
         WHERE x2.is_job),
{Q.report('pred', ('cell', 'model'))},
summ2 AS ({Q.summary('rep', ('cell', 'model'))}),
plan AS (SELECT c.cell, CAST(c.p AS DOUBLE) AS train_prop, c.balance, CAST(c.cap AS BIGINT) AS cap, m.model,
                lpad(CAST(c.cell * {len(MODELS)} + m.mi AS VARCHAR), 6, '0') AS run_id FROM cells c, models m),
sweep AS (SELECT plan.run_id, plan.train_prop, plan.balance, plan.cap, plan.model, nt.n_train, s.accuracy, s.macro_f1,
                 s.precision_macro, s.recall_macro, s.n_eval
          FROM plan LEFT JOIN summ2 s USING (cell, model) LEFT JOIN ntrain nt USING (cell))"""
SWEEP_COLS = "run_id, train_prop, balance, cap, model, n_train, accuracy, macro_f1, precision_macro, recall_macro, n_eval"


def _sweep(spark, sf):
    p = PrepareParams()
    dd = D.dedup(filtered_docs(labelled_docs(spark, sf), p, spark), "text")
    return materialize(X.sweep(dd, CELLS, 42, models=MODELS))


@query("sweep_learning_curve", f"WITH {PREP}, {SWEEP} SELECT {SWEEP_COLS} FROM sweep")
def q_sweep(spark, sf):
    return _sweep(spark, sf)


def _sweep_models(spark, sf):
    docs = D.dedup(filtered_docs(labelled_docs(spark, sf), PrepareParams(), spark), "text")
    cells = CELLS[:-1]
    return materialize(X.sweep_models(materialize(docs.select("id", "text", "label")), cells)), cells


@query("sweep_models")
def q_sweep_models(spark, sf):
    """A linear model in every cell of the sweep, all trained in one shared scan."""
    s, cells = _sweep_models(spark, sf)
    plan = spark.createDataFrame([(i, float(c["train_prop"]), c["balance"], int(c["cap"])) for i, c in enumerate(cells)], "cell int, train_prop double, balance string, cap long")
    return s.join(F.broadcast(plan), "cell").select("cell", "train_prop", "balance", "cap", "n_train", "accuracy", "macro_f1", "precision_macro", "recall_macro", "n_eval")


@query("sweep_model_counts", f"""WITH {PREP}, {SWEEP}, e AS (SELECT cell, count(*) AS n_eval FROM x2 WHERE is_job GROUP BY cell)
SELECT CAST(cell AS INTEGER) AS cell, n_train, n_eval, true AS learned FROM ntrain JOIN e USING (cell)""")
def q_sweep_model_counts(spark, sf):
    """What SQL can state of it: the rows each cell learns from and is judged on, and that it learned something."""
    s, _ = _sweep_models(spark, sf)
    return s.select("cell", "n_train", "n_eval", (F.col("accuracy") > 0.5).alias("learned"))


@query("learning_curve_points", f"""WITH {PREP}, {SWEEP}
SELECT balance, model, count(*) AS n_points,
       string_agg(printf('%.3f', train_prop) || ':' || printf('%.6f', macro_f1), ';' ORDER BY train_prop, macro_f1) AS points
FROM sweep WHERE train_prop IS NOT NULL AND macro_f1 IS NOT NULL GROUP BY balance, model""")
def q_curves(spark, sf):
    return X.learning_curves(_sweep(spark, sf), "train_prop", "macro_f1", ["balance", "model"])


@query("quality_flags", f"""WITH {PREP}, {SWEEP},
fl AS (SELECT *, n_train IS NOT NULL AND model = 'majority' AS judged FROM sweep)
SELECT run_id, model, accuracy, macro_f1, CASE WHEN n_train IS NULL THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN judged THEN coalesce(accuracy, 0) >= 0.86 AND coalesce(macro_f1, 0) >= 0.5 END AS quality_ok,
  CASE WHEN judged THEN array_to_string(list_filter([CASE WHEN coalesce(accuracy, 0) < 0.86 THEN 'low_accuracy' END,
    CASE WHEN coalesce(macro_f1, 0) < 0.5 THEN 'low_macro_f1' END], lambda x: x IS NOT NULL), ',') END AS quality_flags
FROM fl""")
def q_flags(spark, sf):
    s = _sweep(spark, sf).withColumn("status", F.when(F.col("n_train").isNull(), "failed").otherwise("success"))
    return quality_flags(s.select("run_id", "model", "accuracy", "macro_f1", "status"), 0.86, 0.5, "model", ["majority"], "status")


GRID_MODELS = ("majority", "source_majority")


@query("experiment_grid", f"""WITH g AS (SELECT l.lang AS corpus, CAST(p.p AS DOUBLE) AS train_prop, m.model
  FROM (SELECT DISTINCT lang FROM documents) l, (VALUES (0.5), (0.8)) p(p), (VALUES {", ".join(f"('{m}')" for m in GRID_MODELS)}) m(model)),
o AS (SELECT *, row_number() OVER (ORDER BY corpus, train_prop, model) - 1 AS k FROM g)
SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS run_id, corpus, train_prop, model, CAST(42 + k AS BIGINT) AS seed,
       CAST(json_object('corpus', corpus, 'train_prop', train_prop, 'model', model) AS VARCHAR) AS axis_values_json FROM o""")
def q_grid(spark, sf):
    langs = read_table(spark, sf, "documents").select(F.col("lang").alias("corpus")).distinct()
    g = (langs.select("corpus", F.explode(F.array(F.lit(0.5), F.lit(0.8))).alias("train_prop"))
         .select("*", F.explode(F.array(*[F.lit(m) for m in GRID_MODELS])).alias("model")))
    # the grid has (distinct corpora x axis values) rows: a small table ranked in one task
    k = F.row_number().over(Window.orderBy("corpus", "train_prop", "model")) - 1
    g = g.withColumn("k", k)
    return g.select(F.lpad(F.col("k").cast("string"), 6, "0").alias("run_id"), "corpus", "train_prop", "model",
                    (F.lit(42) + F.col("k")).cast("bigint").alias("seed"),
                    F.to_json(F.struct("corpus", "train_prop", "model")).alias("axis_values_json"))


#: One run per language, source and baseline: the runs grow with the data's keys.
GROUP = ("corpus_id", "view", "model_id")
RUNS = f"""gmaj AS (SELECT label AS majority FROM v WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
smaj AS (SELECT source AS s, label AS lab FROM (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, label) AS r
           FROM v WHERE split = 'train' GROUP BY source, label) WHERE r = 1),
pred AS (SELECT v.modality AS corpus_id, v.source AS view, m.model_id, v.label AS y_true, CASE WHEN m.model_id = 'majority' THEN gmaj.majority ELSE coalesce(smaj.lab, gmaj.majority) END AS y_pred
         FROM v LEFT JOIN smaj ON v.source = smaj.s, gmaj, (VALUES ('majority'), ('source_majority')) m(model_id) WHERE v.split = 'job'),
{Q.report('pred', GROUP)},
gsum AS ({Q.summary('rep', GROUP)}),
run0 AS (SELECT d.lang || '-' || d.source || '-' || m.model_id AS run_id, d.lang AS corpus_id, d.source AS view, m.model_id, CASE WHEN n_eval IS NULL THEN 'failed' ELSE 'success' END AS status,
         accuracy, macro_f1, precision_macro, recall_macro, n_eval FROM (SELECT DISTINCT lang, source FROM documents) d, (VALUES ('majority'), ('source_majority')) m(model_id)
         LEFT JOIN gsum ON gsum.corpus_id = d.lang AND gsum.view = d.source AND gsum.model_id = m.model_id)"""
#: A run leaves a meta file besides its metrics only if it judged so many documents.
META_LEAST = 3


def _group_runs(spark, sf):
    """``run_id, corpus_id`` (language), ``view`` (source), ``model_id, status`` and the metrics of both baselines for every language and
    source of the documents; a run fails where the job split has no document of them."""
    v = prepare(spark, sf, with_text=False)
    by_source = source_majority_predictions(v, id_col="rid").select("rid", F.col("y_pred").alias("by_source"))
    maj = majority_label(v.where("split = 'train'")).scalar()
    job = v.where("split = 'job'").join(by_source, "rid")
    models = F.explode(F.array(F.struct(F.lit("majority").alias("model_id"), maj.alias("y_pred")),
                               F.struct(F.lit("source_majority").alias("model_id"), F.col("by_source").alias("y_pred")))).alias("m")
    pred = job.select(F.col("modality").alias("corpus_id"), F.col("source").alias("view"), F.col("label").alias("y_true"), models).select("*", "m.*")
    summ = summary_metrics(classification_report(pred, keys=GROUP), GROUP)
    plan = read_table(spark, sf, "documents").select(F.col("lang").alias("corpus_id"), F.col("source").alias("view")).distinct()
    plan = plan.withColumn("model_id", F.explode(F.array(F.lit("majority"), F.lit("source_majority"))))
    r = plan.join(summ, list(GROUP), "left").withColumn("status", F.when(F.col("n_eval").isNull(), "failed").otherwise("success"))
    return materialize(r.withColumn("run_id", F.concat_ws("-", *GROUP)).withColumn("family", F.lit("baseline")))


def _run_files(spark, sf):
    """Spark writes the metrics tree (a folder per corpus, view, family and model; failed runs have none), the meta tree beside it and the
    runs table. Returns their root and the runs table as it was read back."""
    root = scratch_path(spark, RF.fresh("exp"))
    d = _group_runs(spark, sf)
    metrics = F.to_json(F.struct("accuracy", "macro_f1", "precision_macro", "recall_macro", F.struct(F.col("n_eval").alias("support")).alias("report")), {"pretty": "true"})
    meta = F.to_json(F.struct(F.lit("quick").alias("profile"), F.lit("label").alias("label_field"), F.lit("1").alias("pipeline_version"), F.col("n_eval").alias("n_eval_docs")), {"pretty": "true"})
    done = d.where("status = 'success'")
    RF.write_tree(done.withColumn("value", metrics), f"{root}/metrics")
    RF.write_tree(done.where(F.col("n_eval") >= META_LEAST).withColumn("value", meta), f"{root}/meta")
    runs = d.select("run_id", F.lit("groups").alias("exp_id"), F.lit("train").alias("stage"), "status", "family", "model_id", "corpus_id", "view",
                    F.to_json(F.struct(F.col("corpus_id").alias("lang"), F.col("view").alias("source"), F.col("model_id").alias("model"))).alias("axis_values_json"),
                    F.to_json(F.struct(F.lit("0.8").alias("TRAIN_PROP"))).alias("make_vars_json"),
                    RF.leaf_of(F.lit(f"{root}/metrics")).alias("metrics_path"), F.concat(F.lit("logs/"), "run_id", F.lit(".log")).alias("log_path"))
    RF.write_table(runs, f"{root}/runs", RF.RUN_COLUMNS)
    return root, RF.read_table_tsv(spark, f"{root}/runs", RF.RUN_COLUMNS)


_NUM = ("accuracy", "macro_f1", "precision_macro", "recall_macro")


@query("metrics_global", f"""WITH {PREP}, {RUNS}
SELECT run_id, status, 'baseline' AS family, model_id, corpus_id, view, '' AS dataset_id, '0.8' AS make_TRAIN_PROP, corpus_id AS axis_lang, view AS axis_source,
       model_id AS axis_model, CASE WHEN status = 'success' THEN '{{"support":' || n_eval || '}}' ELSE '' END AS report, {", ".join(_NUM)} FROM run0""")
def q_metrics_global(spark, sf):
    root, runs = _run_files(spark, sf)
    files = RF.tree_files(spark, f"{root}/metrics")
    g = RF.metrics_global(runs, files.withColumn("path", F.col("dir")))
    return g.select("run_id", "status", "family", "model_id", "corpus_id", "view", "dataset_id", "make_TRAIN_PROP", "axis_lang", "axis_source",
                    "axis_model", "report", *[F.col(c).try_cast("double").alias(c) for c in _NUM])


@query("run_report", f"""WITH {PREP}, {RUNS}
SELECT count(*) AS n_runs, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS n_success,
       CAST(sum(CASE WHEN status <> 'success' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed FROM run0""")
def q_run_report(spark, sf):
    return X.run_report(_run_files(spark, sf)[1])


@query("run_report_lines", f"""WITH {PREP}, {RUNS}, c AS (SELECT count(*) AS n, sum((status = 'success')::INT) AS s FROM run0)
SELECT unnest(['h00', 'h01', 'h02', 'h03', 'h04', 'h05', 'h06']) AS no, unnest(['# Experiment report: groups', '', 'Total runs: ' || n,
  'Successes: ' || s, 'Failures: ' || (n - s), '', '## Runs']) AS line FROM c
UNION ALL SELECT 'r' || run_id, '- **' || run_id || '** — status: ' || status || ', log: logs/' || run_id || '.log' FROM run0""")
def q_run_report_lines(spark, sf):
    return RF.report_lines(_run_files(spark, sf)[1], "groups")


@query("typed_metrics", f"""WITH {PREP}, {SWEEP}
SELECT CAST(run_id AS DOUBLE) AS run_id, train_prop, balance, CAST(cap AS DOUBLE) AS cap, model, CAST(n_train AS DOUBLE) AS n_train,
       accuracy, macro_f1, precision_macro, recall_macro, CAST(n_eval AS DOUBLE) AS n_eval FROM sweep""")
def q_typed_metrics(spark, sf):
    path = scratch_path(spark, f"metrics-tsv-{uuid.uuid4().hex[:12]}")
    _sweep(spark, sf).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)  # every column a string
    # one aggregate row: does every non-blank value of a column parse as a number?
    flags = raw.agg(*[F.sum(F.when((F.trim(c) != "") & F.col(c).try_cast("double").isNull(), 1).otherwise(0)).alias(c)
                      for c in raw.columns]).first()
    return raw.select(*[(F.col(c).try_cast("double") if flags[c] == 0 else F.col(c)).alias(c) for c in raw.columns])


@query("metrics_tree", f"""WITH {PREP}, {RUNS}
SELECT corpus_id, view, 'baseline' AS family, model_id, CASE WHEN n_eval >= {META_LEAST} THEN 'quick' ELSE '' END AS profile, CASE WHEN n_eval >= {META_LEAST} THEN 'label' ELSE '' END AS label_field,
       CASE WHEN n_eval >= {META_LEAST} THEN '1' ELSE '' END AS pipeline_version, CASE WHEN n_eval >= {META_LEAST} THEN CAST(n_eval AS VARCHAR) ELSE '' END AS n_eval_docs,
       {", ".join(_NUM)} FROM run0 WHERE status = 'success'""")
def q_metrics_tree(spark, sf):
    """Scan the tree, join each metrics file with its meta file, write the twelve-column summary and read it back."""
    root, _ = _run_files(spark, sf)
    summary = RF.tree_summary(RF.tree_files(spark, f"{root}/metrics"), RF.tree_files(spark, f"{root}/meta"))
    RF.write_table(summary, f"{root}/summary", RF.SUMMARY_COLUMNS, RF.DIMENSIONS)
    s = RF.read_table_tsv(spark, f"{root}/summary", RF.SUMMARY_COLUMNS)
    return s.select(*RF.SUMMARY_COLUMNS[:8], *[F.col(c).try_cast("double").alias(c) for c in _NUM])


@query("metrics_flat", """WITH m AS (SELECT d.source, d.lang, count(*) AS n, sum(length(text)) AS chars, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.quality = 0) AS bad
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY d.source, d.lang)
SELECT source, lang, k AS key, v AS value FROM (SELECT source, lang, unnest(['n', 'report.length.sum', 'report.labels.good', 'report.labels.bad', 'report.tags', 'name.first']) AS k,
  unnest([n::VARCHAR, chars::VARCHAR, good::VARCHAR, bad::VARCHAR, '["' || lang || '",1]', source]) AS v FROM m)""")
def q_metrics_flat(spark, sf):
    """Nested metrics files, one per source and language, written by Spark into a tree of folders, scanned and flattened to dotted keys."""
    quality = read_table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = read_table(spark, sf, "documents").select("doc_id", "source", "lang", F.length("text").alias("chars")).join(quality, "doc_id", "left")
    m = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.count(F.when(F.col("quality") == 1, 1)).alias("good"),
                                        F.count(F.when(F.col("quality") == 0, 1)).alias("bad"))
    nested = F.struct("n", F.struct(F.struct(F.col("chars").alias("sum")).alias("length"), F.struct("good", "bad").alias("labels")).alias("report"),
                      F.struct(F.col("source").alias("first")).alias("name"))
    # an array of mixed types has no Spark type: its JSON is put together as text
    text = F.regexp_replace(F.to_json(nested), '"labels":', F.concat(F.lit('"tags":["'), "lang", F.lit('",1],"labels":')))
    path = scratch_path(spark, RF.fresh("metrics-tree"))
    m.select("source", "lang", text.alias("value")).repartition("source", "lang").write.partitionBy("source", "lang").text(path)
    files = spark.read.text(path, wholetext=True)
    return X.flatten_json(files, "value", ["source", "lang"])


@query("label_marks", """WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id)
SELECT d.doc_id AS id, CASE WHEN q IS NULL THEN '__NO_LABEL__' WHEN q = 1 THEN 'good' ELSE 'bad' END AS y_true,
  CASE WHEN t IS NULL THEN '__NO_PRED__' WHEN t = 1 THEN 'toxic' ELSE 'clean' END AS y_pred FROM documents d LEFT JOIN l USING (doc_id)""")
def q_label_marks(spark, sf):
    """Class scores to labels by argmax, with the marks of documents that have none."""
    lab = read_table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    d = read_table(spark, sf, "documents").select("doc_id").join(lab, "doc_id", "left")

    def scores(c, yes, no):
        s = F.col(c).cast("double")
        return F.when(s.isNotNull(), F.create_map(F.lit(no), 1 - s, F.lit(yes), s)).otherwise(F.create_map().cast("map<string,double>"))
    return d.select(F.col("doc_id").alias("id"), argmax_label(scores("q", "good", "bad"), NO_LABEL).alias("y_true"),
                    argmax_label(scores("t", "toxic", "clean"), NO_PRED).alias("y_pred"))
