"""Run tables and metrics trees on hand-made files."""

from pyspark.sql import functions as F

from tessel.operators.metrics import quality_flags
from tessel.session import scratch_path
from tessel.sources import runs as R


def test_tree_runs_and_global_table(spark):
    root = scratch_path(spark, R.fresh("runs-test"))
    files = {"web1/v/svm/m1/metrics.json": '{\n "accuracy": 0.75,\n "macro_f1": 0.6, "per": {"a": {"f1": 1}}\n}',
             "web1/v/svm/m1/meta_eval.json": '{"profile": "quick",\n "n_eval_docs": 12}', "web1/v/svm/m2/metrics.json": '{"accuracy": '}
    for name, text in files.items():
        R.write_text(spark, f"{root}/reports/{name}", text)
    got = {r.model_id: r for r in R.metrics_tree(spark, f"{root}/reports").collect()}
    assert (got["m1"].corpus_id, got["m1"].family, got["m1"].profile, got["m1"].n_eval_docs, got["m1"].accuracy) == ("web1", "svm", "quick", "12", "0.75")
    assert (got["m2"].accuracy, got["m2"].profile) == ("", "")
    rows = [("000001", "failed", None, "{bad", "{}"), ("000000", "success", f"file:{root}/reports/web1/v/svm/m1/metrics.json".replace("file:file:", "file:"),
                                                      '{"train_prop": 0.5, "model": "svm"}', '{"TRAIN_PROP": "0.5"}')]
    df = spark.createDataFrame(rows, "run_id string, status string, metrics_path string, axis_values_json string, make_vars_json string")
    R.write_table(df, f"{root}/runs", R.RUN_COLUMNS)
    back = R.read_table_tsv(spark, f"{root}/runs", R.RUN_COLUMNS)
    assert back.columns == list(R.RUN_COLUMNS) and [r.run_id for r in back.collect()] == ["000000", "000001"]
    g = R.metrics_global(back, R.json_files(spark, f"{root}/reports", "metrics.json"))
    assert g.columns == [*R.RUN_COLUMNS, "accuracy", "axis_model", "axis_train_prop", "macro_f1", "make_TRAIN_PROP", "per"]
    one = {r.run_id: r for r in g.collect()}
    assert one["000000"].per == '{"a":{"f1":1}}' and one["000000"].axis_train_prop == "0.5" and one["000001"].accuracy == ""
    lines = [r.line for r in R.report_lines(back, "t").orderBy("no").collect()]
    assert lines[2:5] == ["Total runs: 2", "Successes: 1", "Failures: 1"] and lines[7].startswith("- **000000** — status: success")


def test_flags_only_for_judged_runs(spark):
    df = spark.createDataFrame([("a", "svm", "success", 0.5, 0.4), ("b", "svm", "success", 0.9, None), ("c", "svm", "failed", 0.1, 0.1),
                                ("d", "cnn", "success", 0.1, 0.1), ("e", "svm", "success", 0.9, 0.9)], "id string, family string, status string, accuracy double, macro_f1 double")
    got = {r.id: (r.quality_ok, r.quality_flags) for r in quality_flags(df, 0.6, 0.5, "family", ["svm"], "status").collect()}
    assert got == {"a": (False, "low_accuracy,low_macro_f1"), "b": (False, "low_macro_f1"), "c": (None, None), "d": (None, None), "e": (True, "")}


def test_tree_written_by_spark(spark):
    root = scratch_path(spark, R.fresh("tree-test"))
    rows = [("en", "src1", "baseline", "m1", '{\n "accuracy": 0.5, "per": {"a": 1}\n}'), ("en", "src2", "baseline", "m1", '{"accuracy": '), ("fr", "src1", "svm", "m2", "{}")]
    cols = "corpus_id string, view string, family string, model_id string, value string"
    R.write_tree(spark.createDataFrame(rows, cols).repartition(3), f"{root}/metrics")
    R.write_tree(spark.createDataFrame([("en", "src1", "baseline", "m1", '{"profile": "quick"}')], cols), f"{root}/meta")
    files = R.tree_files(spark, f"{root}/metrics")
    got = {(r.corpus_id, r.view): r for r in R.tree_summary(files, R.tree_files(spark, f"{root}/meta")).collect()}
    assert (got["en", "src1"].accuracy, got["en", "src1"].profile) == ("0.5", "quick")
    assert (got["en", "src2"].accuracy, got["en", "src2"].profile) == ("", "") and got["fr", "src1"].model_id == "m2"
    at = spark.createDataFrame(rows, cols).select(R.leaf_of(F.lit(f"{root}/metrics")).alias("dir"))
    assert sorted(r.dir for r in at.collect()) == sorted(r.dir for r in files.collect())
