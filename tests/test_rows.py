"""Row identity: repeated and missing ids, quotas of rare labels, one text scan."""

import pytest
from pyspark.sql import functions as F

from tessel.operators import balance as B
from tessel.operators import dedup as D
from tessel.operators import split as S
from tessel.plans.prepare import PrepareParams, prepare, prepare_frame, stages, write_view_meta
from tessel.session import scratch_path

ROWS = [(1, "aa x"), (1, "aa x"), (1, "bb"), (2, "cc"), (None, "dd"), (None, "ee"), (None, "dd"), (3, "AA  x")]
WANT = {"id": [(1, "aa x"), (2, "cc"), (3, "AA  x"), (None, "dd"), (None, "ee")],
        "text": [(1, "aa x"), (1, "bb"), (2, "cc"), (None, "dd"), (None, "ee")],
        "id_and_text": [(1, "aa x"), (1, "bb"), (2, "cc"), (3, "AA  x"), (None, "dd"), (None, "ee")]}


@pytest.mark.parametrize("mode", list(WANT))
@pytest.mark.parametrize("keyed", [False, True])
def test_dedup_modes_on_repeated_and_null_ids(spark, mode, keyed):
    df = spark.createDataFrame([(i, t, f"r{n}", n) for n, (i, t) in enumerate(ROWS)], "id int, text string, rid string, pos int")
    out = D.dedup(df if keyed else df.drop("rid"), mode, "pos", row_id="rid" if keyed else None)
    assert sorted(((r.id, r.text) for r in out.collect()), key=str) == sorted(WANT[mode], key=str)


def _frame(spark, n=40):
    rows = [(i % 5, f"text number {i} " + "w " * 30, "a" if i % 4 else "b", "web", "s") for i in range(n)] + [(None, "no id " + "w " * 30, "a", "web", "s")]
    return spark.createDataFrame(rows, "id int, text string, label string, modality string, source string")


def test_prepare_keeps_rows_with_repeated_ids(spark):
    v = prepare_frame(_frame(spark), PrepareParams(min_chars=10, dedup_on="none"))
    assert v.count() == 41 and v.select("rid").distinct().count() == 41 and v.select("text").distinct().count() == 41
    c = {(r.label, r.split): r["count"] for r in v.groupBy("label", "split").count().collect()}
    assert c == {("a", "train"): 25, ("a", "job"): 6, ("b", "train"): 8, ("b", "job"): 2}
    assert prepare_frame(_frame(spark), PrepareParams(min_chars=10, dedup_on="id")).count() == 6


def test_prepare_with_actors_and_meta_file(spark):
    from tessel.operators.actors import actors_frame
    actors = actors_frame(spark, [("a1", ["s"], [], "left", "left", None, None)])
    d = _frame(spark).withColumn("crawl", F.when(F.col("label") == "a", "s").otherwise("other")).withColumn("domain", F.lit(None).cast("string"))
    p = PrepareParams(min_chars=10, dedup_on="none", actors=actors, actor_col="actor")
    st = stages(d, p)
    assert {r.label for r in st.view.collect()} == {"left"} and st.view.count() == 31
    assert {r.reason for r in st.labelled.select("reason").distinct().collect()} == {"ok", "unknown_actor_dropped"}
    path = write_view_meta(st, p, scratch_path(spark, "meta-test"))
    kinds = {r.kind: r.value for r in spark.read.json(path).collect()}
    assert '"n_view":31' in kinds["stages"] and kinds["reason"] == '{"ok":31,"unknown_actor_dropped":10}'


def test_text_is_scanned_twice_whatever_the_balance(spark):
    """The final plan reads texts once, next to the key table; the key pass reads them once before."""
    sf = "/root/testdata/sf0.001"
    for kw in ({}, {"balance": "alpha_total", "total": 40, "alpha": 0.5}, {"balance": "cap_tokens", "cap_tokens": 5000}):
        plan = prepare(spark, sf, PrepareParams(**kw))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("text#") and sum("documents" in x or ",text#" in x and "Relation" in x for x in plan.splitlines()) == 1


def test_rare_labels_keep_a_quota(spark):
    rows = [(i, "z_big") for i in range(1000)] + [(2000 + i, f"r{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "id int, label string")
    q = {r.label: r.quota for r in B.alpha_quotas(df, 1.0, 10).collect()}
    assert q == {**{f"r{i}": 1 for i in range(9)}, "z_big": 1}
    q = {r.label: r.quota for r in B.alpha_quotas(df, 1.0, 50).collect()}
    assert q == {**{f"r{i}": 1 for i in range(9)}, "z_big": 41}
    with pytest.raises(Exception, match="number of labels"):
        B.alpha_quotas(df, 1.0, 5).collect()


def test_more_labels_than_quotas(spark):
    """As the window functions of ``alpha_quotas_rare`` deal them: one each in label order."""
    df = spark.createDataFrame([(i, "z_big") for i in range(100)] + [(2000 + i, f"r{i}") for i in range(9)], "id int, label string")
    q = {r.label: r.quota for r in B.alpha_quotas(df, 1.0, 5, may_drop=True).collect()}
    assert q == {**{f"r{i}": int(i < 5) for i in range(9)}, "z_big": 0}
    assert {r.label: r.quota for r in B.alpha_quotas(df, 1.0, 50, may_drop=True).collect()} == {r.label: r.quota for r in B.alpha_quotas(df, 1.0, 50).collect()}


def test_no_cap_leaves_the_train_set_alone(spark):
    df = spark.createDataFrame([(i, "a", 3) for i in range(7)], "id int, label string, tokens int")
    assert B.cap_docs(df, 0).count() == 7 and B.cap_tokens(df, 0).count() == 7


def test_take_first_by_numbers(spark):
    df = spark.range(-50, 25_000).repartition(7)
    assert sorted(r.id for r in S.take_first(df, 60, "id").collect()) == list(range(-50, 10))
