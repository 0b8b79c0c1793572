"""Experiment sweeps as Spark jobs: grid of runs, per-run baseline metrics,
the runs ⟕ metrics table, run report, quality flags and learning curves.

A sweep over ``train_prop x balance x model`` is one job: documents are
hash-ranked once per label (bucketed rank), each row fans out to the small,
fixed list of cells (a generator, not a join), split/balance membership is
a comparison against the rank, and all metrics come from one confusion
aggregation keyed by run.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.hashing import order_key
from tessel.operators.metrics import confusion, report_from_confusion, summary_metrics
from tessel.plans.rank import bucketed_rank
from tessel.session import materialize

MODELS = ("majority", "source_majority")


def sweep(docs: DataFrame, cells: Sequence[dict], seed: int = 42, label_col: str = "label",
          id_col: str = "id", source_col: str = "source", models: Sequence[str] = MODELS) -> DataFrame:
    """Baseline metrics per run: ``run_id, train_prop, balance, cap, model,
    n_train, accuracy, macro_f1, precision_macro, recall_macro, n_eval``."""
    d = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(source_col).alias("source"))
    d = d.withColumn("__h", order_key("id", seed))
    r = bucketed_rank(d, ["label"], "__h", "id", rank_col="r", n_col="n").drop("__h")
    cell_structs = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(float(c["train_prop"])).alias("p"),
                                      F.lit(c.get("cap") or 0).cast("bigint").alias("cap"))
                             for i, c in enumerate(cells)])
    x = r.select("*", F.explode(cell_structs).alias("c")).select("id", "label", "source", "r", "n", "c.*")
    n_tr = F.bround(F.col("p") * F.col("n"), 0)
    limit = F.when(F.col("cap") > 0, F.least(n_tr, F.col("cap"))).otherwise(n_tr)
    x = x.withColumn("is_train", F.col("r") <= limit).withColumn("is_job", F.col("r") > n_tr)
    tr = x.where("is_train")
    per = tr.groupBy("cell", "source", "label").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("cell", "source").orderBy(F.desc("c"), "label")
    smaj = (per.withColumn("k", F.row_number().over(w)).where("k = 1")
            .select("cell", "source", F.col("label").alias("smaj")))
    glob = per.groupBy("cell", "label").agg(F.sum("c").alias("c"))
    wg = Window.partitionBy("cell").orderBy(F.desc("c"), "label")
    gmaj = glob.withColumn("k", F.row_number().over(wg)).where("k = 1").select("cell", F.col("label").alias("gmaj"))
    ntrain = tr.groupBy("cell").agg(F.count(F.lit(1)).alias("n_train"))
    job = (x.where("is_job").select("cell", "source", "label")
           .join(smaj, ["cell", "source"], "left").join(gmaj, "cell", "left"))
    preds = job.select("cell", F.col("label").alias("y_true"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"),
                 (F.col("gmaj") if m == "majority" else F.coalesce("smaj", "gmaj")).alias("y_pred"))
        for m in models])).alias("m")).select("cell", "m.model", "y_true", "m.y_pred")
    conf = preds.groupBy("cell", "model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("cnt"))
    summ = summary_metrics(report_from_confusion(conf, ["cell", "model"]), ["cell", "model"])
    rows = [(i, float(c["train_prop"]), c.get("balance", "none"), int(c.get("cap") or 0), m, None)
            for i, c in enumerate(cells) for m in models]
    rows = [(*r[:5], f"{k:06d}") for k, r in enumerate(rows)]
    plan = docs.sparkSession.createDataFrame(
        rows, "cell int, train_prop double, balance string, cap bigint, model string, run_id string")
    return (F.broadcast(plan).join(summ, ["cell", "model"], "left").join(ntrain, "cell", "left")
            .select("run_id", "train_prop", "balance", "cap", "model", "n_train", "accuracy", "macro_f1",
                    "precision_macro", "recall_macro", "n_eval"))


def sweep_models(docs: DataFrame, cells: Sequence[dict], seed: int = 42, min_df: int = 5, vocab_size: int = 50000, l2: float = 1e-3, steps: int = 60) -> DataFrame:
    """Linear models of all cells in one shared scan: ``cell, n_train, accuracy, macro_f1, precision_macro, recall_macro, n_eval``. ``docs`` has
    ``id, text, label``; a cell trains on the first ``train_prop`` of each label in hash order (at most ``cap``), class-weighted, and is judged on the
    rest. The TF-IDF features are fitted once, on all documents."""
    from tessel.operators import gradient
    from tessel.operators import models as ML
    t = ML.training(docs.select("id", "text", "label"), min_df, vocab_size, use_class_weights=False)
    d = docs.select("id", "label").withColumn("__h", order_key("id", seed))
    r = bucketed_rank(d, ["label"], "__h", "id", rank_col="r", n_col="n").drop("__h")
    n_tr = [F.bround(F.lit(float(c["train_prop"])) * F.col("n"), 0) for c in cells]
    limit = [F.least(n, F.lit(int(c["cap"]))) if c.get("cap") else n for n, c in zip(n_tr, cells)]
    r = r.select("id", "label", F.array(*[F.col("r") <= x for x in limit]).alias("trains"), F.array(*[F.col("r") > x for x in n_tr]).alias("judged"))
    y = F.create_map(*[v for i, name in enumerate(t.labels) for v in (F.lit(name), F.lit(i))])
    table = ML.written(ML.sparse(t.rows, ["id"]).join(r, "id").select("label", y[F.col("label")].alias("y"), "trains", "judged", "at", "x"), "sweep")
    # rows of each class in each cell: cells x classes numbers
    count = table.groupBy("y").agg(*[F.count(F.when(F.col("trains")[i], 1)).alias(f"c{i}") for i in range(len(cells))]).collect()
    n_of = {(i, row["y"]): row[f"c{i}"] for i in range(len(cells)) for row in count}
    present = [sum(n > 0 for (i, _), n in n_of.items() if i == k) for k in range(len(cells))]
    # balanced: every class of a cell has the same sum of weights, and a cell's weights sum to 1
    per = F.create_map(*[v for k in range(len(t.labels)) for v in (F.lit(k), F.array(*[
        F.lit(1.0 / (present[i] * n_of[i, k]) if n_of.get((i, k)) else 0.0) for i in range(len(cells))]))])
    share = F.zip_with("trains", per[F.col("y")], lambda a, b: F.when(a, b).otherwise(0.0))
    weights = gradient.fit_many(table.select("y", share.alias("share"), "at", "x"), len(cells), len(t.labels), t.size, l2, steps)
    pred = gradient.predict_many(table, weights, t.labels)
    summ = summary_metrics(report_from_confusion(confusion(pred, keys=["cell"]), ["cell"]), ["cell"])
    sizes = docs.sparkSession.createDataFrame([(i, sum(n for (k, _), n in n_of.items() if k == i)) for i in range(len(cells))], "cell int, n_train long")
    return F.broadcast(sizes).join(summ, "cell", "left")  # one row per cell


def learning_curves(results: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Curve table: per ``keys`` group, numeric points sorted by ``x`` as
    ``"x:y;..."`` and their count. A group holds one point per run."""
    pts = results.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = pts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("p"))
    return g.select(*keys, F.size("p").cast("bigint").alias("n_points"), F.array_join(F.transform(
        "p", lambda s: F.concat(F.format_number(s["x"], 3), F.lit(":"), F.format_number(s["y"], 6))), ";").alias("points"))


def run_report(runs: DataFrame, status_col: str = "status") -> DataFrame:
    """Totals, successes, failures (per-run lines: ``sources.runs.report_lines``)."""
    return runs.agg(F.count(F.lit(1)).alias("n_runs"),
                    F.sum(F.when(F.col(status_col) == "success", 1).otherwise(0)).cast("bigint").alias("n_success"),
                    F.sum(F.when(F.col(status_col) != "success", 1).otherwise(0)).cast("bigint").alias("n_failed"))


def merge_maps(*maps):
    """Right-most map wins on a shared key (dict-merge semantics), built-ins only."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_zip_with(out, m, lambda k, v1, v2: F.coalesce(v2, v1))
    return out


def flatten_json(df: DataFrame, json_col: str, keys: Sequence[str]) -> DataFrame:
    """``keys..., key, value``: a row for each leaf of a JSON object, nested objects as dotted keys; other values (arrays, too) as text,
    null as null. Empty objects and text that is no JSON object have no rows. One level of nesting a step, until no object is left."""
    spark = df.sparkSession
    todo = df.select(*keys, F.lit("").alias("__path"), F.try_parse_json(json_col).alias("__v"))
    todo, out = todo.where(F.schema_of_variant("__v").startswith("OBJECT")), None
    while True:
        level = todo.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer())).where("key IS NOT NULL").select(
            *keys, F.concat("__path", F.col("key")).alias("key"), F.col("value").alias("__v"))
        inner = F.schema_of_variant("__v").startswith("OBJECT")
        level = materialize(level.withColumn("__inner", F.coalesce(inner, F.lit(False))))
        leaves = level.where("NOT __inner").select(*keys, "key", F.col("__v").cast("string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        todo = level.where("__inner").select(*keys, F.concat("key", F.lit(".")).alias("__path"), "__v")
        if not todo.limit(1).count():
            return out
