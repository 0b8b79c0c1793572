"""Unit tests on hand-made rows for edge cases of the operators."""

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import balance as B
from tessel.operators import dedup as D
from tessel.operators import labels as L
from tessel.operators import metrics as M
from tessel.operators import split as S
from tessel.plans.rank import bucketed_rank, top_k


def test_norm_label_and_keys(spark):
    df = spark.createDataFrame([("  Upper Town ",), ("crawl-somepaper-20240101_120000",), ("a//b\\\\c",)], "s string")
    got = [r[0] for r in df.select(T.norm_label("s")).collect()]
    assert got == ["upper_town", "crawl_somepaper_20240101_120000", "a_b_c"]
    got = [r[0] for r in spark.createDataFrame([("Forêt-Noire  Élargie",)], "s string").select(T.norm_key("s")).collect()]
    assert got == ["foret_noire_elargie"]


def test_token_counts_match_python(spark):
    texts = ["a  b\tc\nd", "", "one", "x, y! z."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.token_count("t", "split")).collect()]
    assert got == [len(t.split()) for t in texts]
    got = [r[0] for r in df.select(T.token_count("t", "simple")).collect()]
    assert got == [len([x for x in t.replace("\n", " ").split(" ") if x]) for t in texts]


def test_ngrams_and_shingles(spark):
    df = spark.createDataFrame([("a b c d",), ("a b",), ("",)], "t string")
    rows = df.select(T.word_ngrams(F.split("t", " "), 2).alias("g"), T.shingles("t", 3).alias("s")).collect()
    assert rows[0]["g"] == ["a", "b", "c", "d", "a b", "b c", "c d"]
    assert rows[0]["s"] == ["a b c", "b c d"]
    assert rows[1]["s"] == []


def test_label_map_policies(spark):
    m = L.label_map_frame(spark, {"Far Left": "left", "x": "", "far-left": "fl2"})
    df = spark.createDataFrame([(1, "far left"), (2, "Other Thing"), (3, None)], "id int, label_raw string")
    for policy, expected in [("drop", ["fl2", None, None]), ("keep", ["fl2", "other_thing", None]),
                             ("other", ["fl2", "other", None])]:
        got = [r[0] for r in L.apply_label_map(df, m, policy).orderBy("id").select("label").collect()]
        assert got == expected, policy


def test_half_even_split_and_disjoint(spark):
    df = spark.createDataFrame([(i, "a") for i in range(5)] + [(10 + i, "b") for i in range(2)], "id int, label string")
    s = S.stratified_split(df, 0.5, 42)
    c = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert c[("a", "train")] == 2 and c[("a", "job")] == 3  # round_half_even(2.5) = 2
    assert c[("b", "train")] == 1 and c[("b", "job")] == 1
    assert s.count() == df.count() and s.select("id").distinct().count() == df.count()


def test_bucketed_rank_equals_plain_window(spark):
    from pyspark.sql import Window
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"),
                                  F.md5(F.col("id").cast("string")).alias("h"))
    a = bucketed_rank(df, ["g"], "h", "id", rank_col="r", n_col="n")
    b = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    diff = a.join(b, ["id"]).where(F.col("r") != F.col("r2")).count()
    assert diff == 0


def test_top_k_exact_with_ties(spark):
    df = spark.createDataFrame([(f"t{i:03d}", i % 7) for i in range(200)], "term string, c long")
    got = sorted(r["term"] for r in top_k(df, "c", "term", 50).collect())
    exp = sorted(r["term"] for r in df.orderBy(F.desc("c"), "term").limit(50).collect())
    assert got == exp


def test_class_weights_and_quotas(spark):
    df = spark.createDataFrame([(i, "a", i + 1) for i in range(5)] + [(10 + i, "b", i + 1) for i in range(2)],
                               "id int, label string, tokens int")
    w = {r["label"]: r["weight"] for r in B.class_weights(df).collect()}
    assert abs(w["a"] - 7 / (2 * 5)) < 1e-12 and abs(w["b"] - 7 / (2 * 2)) < 1e-12
    for alpha in (0.0, 0.5, 1.0):
        q = {r["label"]: r["quota"] for r in B.alpha_quotas(df, alpha, 6).collect()}
        assert sum(q.values()) == 6
    q1 = {r["label"]: r["quota"] for r in B.alpha_quotas(df, 1.0, 7).collect()}
    assert q1 == {"a": 5, "b": 2}  # alpha = 1 keeps proportions


def test_cap_docs_oversample_and_cap_tokens(spark):
    df = spark.createDataFrame([(i, "a", i + 1) for i in range(5)] + [(10 + i, "b", i + 1) for i in range(2)],
                               "id int, label string, tokens int")
    c = B.cap_docs(df, 3, 42, oversample=True)
    per = {r["label"]: r["count"] for r in c.groupBy("label").count().collect()}
    assert per == {"a": 3, "b": 3}
    assert c.where(F.col("id").contains("#dup")).count() == 1
    t = B.cap_tokens(df, 10, 42)
    tot = {r["label"]: r["s"] for r in t.groupBy("label").agg(F.sum("tokens").alias("s")).collect()}
    assert tot["a"] >= 10  # crossing row kept
    assert tot["b"] >= 3  # b (3 tokens) is topped up with duplicates


def test_metrics_zero_division_and_groups(spark):
    rows = [("web1", "a", "a"), ("web1", "b", "b"), ("web2", "a", "b"), (None, "a", None)]
    df = spark.createDataFrame(rows, "corpus_id string, y_true string, y_pred string")
    g = M.metrics_by_group(df, ["corpus_id"])
    acc = {r["group_value"]: r["f1"] for r in g.where("label = 'accuracy'").collect()}
    assert acc == {"web1": 1.0, "web2": 0.0, "__missing__": 0.0}
    rep = M.classification_report(df.where("corpus_id = 'web2'"))
    b = rep.where("label = 'b'").first()
    assert b["precision"] == 0.0 and b["support"] == 0  # label only predicted


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(3, "Hello  World"), (1, "hello world"), (2, "other")], "id int, text string")
    assert sorted(r["id"] for r in D.dedup(df, "text").collect()) == [1, 2]


def test_shuffle_labels_keeps_histogram(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 5 == 0, "x").otherwise("y").alias("label"))
    s = S.shuffle_labels(df, 7)
    h1 = {r[0]: r[1] for r in s.groupBy("label").count().collect()}
    h2 = {r[0]: r[1] for r in s.groupBy("label_shuffled").count().collect()}
    assert h1 == h2 and s.count() == 500


def test_alpha_total_row_count_and_quotas(spark):
    df = spark.createDataFrame([(i, "a") for i in range(9)] + [(20 + i, "b") for i in range(2)], "id int, label string")
    for alpha, total in ((0.0, 12), (0.5, 7), (1.0, 11)):
        out = B.alpha_total(df, alpha, total, 42)
        q = {r["label"]: r["quota"] for r in B.alpha_quotas(df, alpha, total).collect()}
        got = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
        assert out.count() == total and got == {k: v for k, v in q.items() if v > 0}
        dups = out.where(F.col("id").contains("#dup")).groupBy("label").count().collect()
        n = {"a": 9, "b": 2}
        assert all(r["count"] == q[r["label"]] - n[r["label"]] for r in dups)
