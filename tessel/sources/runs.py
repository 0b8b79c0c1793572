"""Experiment files: plan and run tables (TSV), per-run ``metrics.json`` trees, summary and report sinks.

Spark writes trees of its own as partitioned text, one file a leaf
(``corpus_id=.../view=.../family=.../model_id=.../``); trees of other tools are read as well.
There a tree holds one directory per evaluated model,
``<corpus_id>/<view>/<family>/<model_id>/``, with ``metrics.json`` and, optionally, a
sibling ``meta_eval.json``; files may span lines, and an unreadable one counts as empty.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the interchange files, in their order.
PLAN_COLUMNS = ("run_id", "exp_id", "profile", "stage", "repeat_index", "axis_values_json", "make_vars_json",
                "overrides_json", "resource_class")
RUN_COLUMNS = ("run_id", "exp_id", "profile", "stage", "status", "return_code", "family", "model_id", "corpus_id",
               "dataset_id", "view", "train_prop", "axis_values_json", "make_vars_json", "overrides_json",
               "metrics_path", "log_path", "started_at", "finished_at", "duration_s")
SUMMARY_COLUMNS = ("corpus_id", "view", "family", "model_id", "profile", "label_field", "pipeline_version",
                   "n_eval_docs", "accuracy", "macro_f1", "precision_macro", "recall_macro")
DIMENSIONS = ("corpus_id", "view", "family", "model_id")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file through Hadoop's file system, so that any store works."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_table(df: DataFrame, path: str, columns: tuple[str, ...], order: tuple[str, ...] = ("run_id",)) -> str:
    """A TSV of exactly ``columns`` (missing ones empty) in ``order``: one row per run."""
    cols = [(F.col(c).cast("string") if c in df.columns else F.lit("")).alias(c) for c in columns]
    rows = df.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cols, columns)])
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").options(sep="\t", header=True, quote='"', escape='"', emptyValue="").csv(path)
    return path


def read_table_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The table back, every column a string, empty fields empty."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).options(sep="\t", header=True, quote='"', escape='"').csv(path)
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def bare_path(col):
    """A path without its scheme."""
    return F.regexp_replace(col, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def json_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``path, dir, fields`` of every file called ``name`` below ``root``: the top-level fields as
    text (nested values as JSON), null if the file is not a readable object."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    path = bare_path(F.col("_metadata.file_path"))
    return raw.select(path.alias("path"), F.regexp_replace(path, r"/[^/]*$", "").alias("dir"),
                      F.from_json("value", "map<string,string>").alias("fields"))


def write_tree(df: DataFrame, path: str) -> str:
    """``value`` of each row as a file in the folder of its dimensions, written by the tasks and committed together."""
    df.select(*DIMENSIONS, "value").repartition(*DIMENSIONS).write.mode("overwrite").partitionBy(*DIMENSIONS).text(path)
    return path


def leaf_of(root):
    """The folder of a row's dimensions below ``root`` (plain names), as ``tree_files`` gives it."""
    return bare_path(F.concat_ws("/", root, *[F.concat(F.lit(f"{c}="), F.col(c)) for c in DIMENSIONS]))


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """Dimensions, ``dir`` and ``fields`` (as in ``json_files``) of every file of a tree that ``write_tree`` wrote."""
    raw = spark.read.text(root, wholetext=True)
    here = F.regexp_replace(bare_path(F.col("_metadata.file_path")), r"/[^/]*$", "")
    return raw.select(*[F.col(c).cast("string").alias(c) for c in DIMENSIONS], here.alias("dir"), F.from_json("value", "map<string,string>").alias("fields"))


def tree_summary(metrics: DataFrame, meta: DataFrame) -> DataFrame:
    """The twelve summary columns as text: each metrics file with the meta file of the same dimensions, if there is one."""
    e = meta.select(*DIMENSIONS, F.col("fields").alias("e"))
    j = metrics.withColumnRenamed("fields", "m").join(e, list(DIMENSIONS), "left")
    field = lambda col, k: F.coalesce(F.col(col)[k], F.lit("")).alias(k)
    return j.select(*DIMENSIONS, *[field("e", k) for k in SUMMARY_COLUMNS[4:8]], *[field("m", k) for k in SUMMARY_COLUMNS[8:]])


def metrics_tree(spark: SparkSession, root: str) -> DataFrame:
    """Metrics left-joined with their sibling meta file: the twelve summary columns as text."""
    m = json_files(spark, root, "metrics.json").withColumnRenamed("fields", "m")
    meta = json_files(spark, root, "meta_eval.json").select("dir", F.col("fields").alias("e"))
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root.rstrip("/"))
    parts = F.split(F.substring(F.col("dir"), len(base) + 2, 1 << 20), "/")
    j = m.join(meta, "dir", "left")
    dims = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(DIMENSIONS)]
    field = lambda col, k: F.coalesce(F.col(col)[k], F.lit("")).alias(k)
    return j.select(*dims, *[field("e", k) for k in SUMMARY_COLUMNS[4:8]], *[field("m", k) for k in SUMMARY_COLUMNS[8:]])


def metrics_global(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Each run with the metrics found at its ``metrics_path``: the run columns, then, sorted by
    name, every metric any run has, ``axis_<name>`` of the axis JSON, and ``make_TRAIN_PROP`` of the
    make variables. A metric named like a run column replaces it; an axis column never replaces
    one; missing values are empty."""
    j = runs.withColumn("__p", bare_path(F.col("metrics_path"))).join(
        files.select(F.col("path").alias("__fp"), F.col("fields").alias("__m")), F.col("__p") == F.col("__fp"), "left")
    j = j.withColumn("__a", F.from_json("axis_values_json", "map<string,string>")).withColumn("__v", F.from_json("make_vars_json", "map<string,string>"))

    def names(col):  # a handful of strings, whatever the number of runs
        return sorted(r[0] for r in j.select(F.explode(F.map_keys(col)).alias("k")).distinct().collect())

    metric, axis = names("__m"), names("__a")
    extra = {k: F.col("__m")[k] for k in metric if k not in runs.columns}
    for k in axis:
        own = extra.get(f"axis_{k}")
        extra[f"axis_{k}"] = F.coalesce(own, F.col("__a")[k]) if own is not None else F.col("__a")[k]
    # called make_TRAIN_PROP here: names that differ from train_prop in case only cannot live in one frame
    extra["make_TRAIN_PROP"] = F.coalesce(F.col("__v")["TRAIN_PROP"], extra.pop("TRAIN_PROP", F.lit("")))
    base = [F.coalesce(F.col("__m")[c], F.col(c)).alias(c) if c in metric else F.col(c) for c in runs.columns]
    return j.select(*base, *[F.coalesce(extra[k], F.lit("")).alias(k) for k in sorted(extra)])


def report_lines(runs: DataFrame, title: str) -> DataFrame:
    """``no, line`` of the run report: totals, then one line per run in run order."""
    ok = F.count(F.when(F.col("status") == "success", 1))
    head = runs.agg(F.count(F.lit(1)).alias("n"), ok.alias("s")).select(F.posexplode(F.array(
        F.lit(f"# Experiment report: {title}"), F.lit(""), F.concat(F.lit("Total runs: "), F.col("n")), F.concat(F.lit("Successes: "), F.col("s")),
        F.concat(F.lit("Failures: "), F.col("n") - F.col("s")), F.lit(""), F.lit("## Runs"))).alias("p", "line"))
    per = runs.select(F.concat(F.lit("r"), "run_id").alias("no"), F.concat(
        F.lit("- **"), "run_id", F.lit("** — status: "), "status", F.lit(", log: "), "log_path").alias("line"))
    return head.select(F.format_string("h%02d", "p").alias("no"), "line").unionByName(per)


def write_report(runs: DataFrame, title: str, path: str) -> str:
    report_lines(runs, title).orderBy("no").select("line").coalesce(1).write.mode("overwrite").text(path)
    return path


def fresh(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex[:12]}"
