"""Models: separable classes, class weights, idf, held-out rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import models as ML
from tessel.operators import perceptron
from tessel.operators.metrics import classification_report
from tessel.session import scratch_path


def _view(spark, minority=30, noise=0.0, n=160):
    r = random.Random(4)
    common = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        lab = "b" if i < minority else "a"
        key = lab if r.random() >= noise else "ab"[lab == "a"]
        words = r.choices(common, k=20) + [f"{key}{r.randrange(3)}x" for _ in range(4)]
        r.shuffle(words)
        rows.append((i, " ".join(words), lab, "job" if i % 4 == 0 else "train"))
    return spark.createDataFrame(rows, "id int, text string, label string, split string").repartition(2)


def _scores(pred):
    return {r.label: r for r in classification_report(pred).collect()}


@pytest.mark.parametrize("kind", ["svm_linear", "logreg", "dtree", "rforest"])
def test_separable_classes_are_separated(spark, kind):
    s = _scores(ML.fit_predict(_view(spark), kind, min_df=2))
    assert s["accuracy"].f1 >= (1.0 if kind != "dtree" else 0.85)


def test_bag_of_words_predicts_the_label(spark):
    assert _scores(ML.bow_predict(_view(spark), num_features=1 << 12))["accuracy"].f1 == 1.0


def test_weights_move_the_minority_and_every_model_beats_the_majority(spark):
    v = _view(spark, minority=24, noise=0.35).cache()
    plain = _scores(ML.fit_predict(v, "logreg", min_df=2, use_class_weights=False))
    weighted = _scores(ML.fit_predict(v, "logreg", min_df=2))
    assert weighted["b"].recall >= plain["b"].recall
    n = v.where("split = 'job'").groupBy("label").count().collect()
    majority = _scores(v.where("split = 'job'").select(F.col("label").alias("y_true"), F.lit("a").alias("y_pred")))
    assert len(n) == 2 and weighted["macro avg"].f1 > majority["macro avg"].f1


def test_tfidf_features_have_the_added_one(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa cc")], "id int, text string")
    m = ML.fit_tfidf(df, min_df=1, bigrams=False)
    v = m.transform(df).orderBy("id").first()["features"]
    import math
    idf = {"aa": math.log(3 / 3) + 1, "bb": math.log(3 / 2) + 1}
    norm = math.sqrt(sum(x * x for x in idf.values()))
    assert sorted(round(float(x), 6) for x in v.values if x) == sorted(round(x / norm, 6) for x in idf.values())


def sequential_perceptron(rows, classes, size, epochs):
    """Averaged multi-class perceptron, one row after the other, every weight vector added up."""
    w, total, n = np.zeros((classes, size + 1)), np.zeros((classes, size + 1)), 0
    for _ in range(epochs):
        errors = 0
        for y, k, at, x in rows:
            v = np.zeros(size + 1)
            v[at], v[-1] = x, 1.0
            p = int((w @ v).argmax())
            if p != y:
                errors += 1
                w[y] += k * v
                w[p] -= k * v
            total += w
            n += 1
        if not errors:
            return w
    return total / n


def perceptron_rows(n, size, classes, noise, seed=1):
    r = np.random.default_rng(seed)
    truth = r.normal(size=(classes, size))
    rows = []
    while len(rows) < n:
        at = np.sort(r.choice(size, 6, replace=False))
        x = r.random(6)
        s = truth[:, at] @ x
        top = np.sort(s)[::-1]
        if top[0] - top[1] > 0.3:
            y = int(s.argmax()) if r.random() >= noise else int(r.integers(classes))
            rows.append((y, float(r.choice([0.5, 1.0, 2.0])), at.tolist(), x.tolist()))
    return rows


def test_perceptron_against_the_sequential_one(spark):
    for noise in (0.0, 0.2):
        rows = perceptron_rows(150, 20, 3, noise)
        df = spark.createDataFrame(rows, "y int, w double, at array<int>, x array<double>").coalesce(1)
        got, history = perceptron.fit(df, 3, 20, max_iter=8, tol=-1.0)
        assert np.allclose(got, sequential_perceptron(rows, 3, 20, 8))
        assert len(history) <= 8


def test_perceptron_of_several_partitions_separates(spark):
    rows = perceptron_rows(300, 20, 3, 0.0)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, y int, w double, at array<int>, x array<double>").repartition(5, "id")
    w, history = perceptron.fit(df, 3, 20, max_iter=300, tol=-1.0)
    assert history[-1] == 0
    got = dict(perceptron.predict(df, w, ["0", "1", "2"], ["id"]).collect())
    assert all(got[i] == str(y) for i, (y, *_) in enumerate(rows))
    assert perceptron.fit(df.limit(0), 3, 20)[1] == []


def test_perceptron_on_texts(spark):
    assert _scores(ML.perceptron_predict(_view(spark), min_df=2))["accuracy"].f1 == 1.0


def test_chi_square_picks_the_telling_terms(spark):
    t = ML.training(_view(spark).where("split = 'train'"), min_df=2, select_terms=6)
    names = t.counts.stages[-1].vocabulary
    assert {"b0x", "b1x", "b2x"} <= {names[i] for i in t.weigh.stages[-1].getIndices()} and t.size == 6
    all_ = ML.training(_view(spark).where("split = 'train'"), min_df=2)
    rows = [(r.label, r.features.toArray()) for r in all_.rows.collect()]
    x, y = np.array([v for _, v in rows]), np.array([g for g, _ in rows])
    o = np.array([x[y == g].sum(0) for g in ("a", "b")])
    e = np.outer([(y == g).mean() for g in ("a", "b")], x.sum(0))
    chi2 = np.round(((o - e) ** 2 / e).sum(0), 9)
    assert sorted(np.lexsort((np.arange(len(chi2)), -chi2))[:6]) == t.weigh.stages[-1].getIndices()


def test_a_stored_model_predicts_the_same(spark):
    v = _view(spark)
    model, _ = ML.fit_text_model(v.where("split = 'train'"), "svm_linear", min_df=2)
    path = model.save(scratch_path(spark, f"model-{random.random()}"))
    again = ML.TextModel.load(spark, path)
    assert again.labels == model.labels == ["a", "b"]
    a, b = (sorted((r.id, r.y_pred, str(r.scores)) for r in m.scores(v, ["id"]).collect()) for m in (model, again))
    assert a == b and len(a) == 160


def test_term_counts_are_those_of_all_documents_and_ties_go_by_term(spark, monkeypatch):
    texts = ["bb aa bb aa", "aa", "", "x", "cc bb aa dd", "aa bb " * 30, "Éa éa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(1)
    ctf, docs = {}, {}
    for t in texts:
        w = [x for x in t.lower().split() if len(x) > 1]
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        for x in terms:
            ctf[x] = ctf.get(x, 0) + 1
        for x in set(terms):
            docs[x] = docs.get(x, 0) + 1
    for at_once in (3, ML.TOKENS_AT_ONCE):
        monkeypatch.setattr(ML, "TOKENS_AT_ONCE", at_once)
        tokens = ML.tfidf_stages()[0].transform(df)
        assert {r.term: (r.df, r.ctf) for r in ML.term_counts(tokens).collect()} == {x: (docs[x], ctf[x]) for x in ctf}
    order = sorted((x for x in ctf if docs[x] >= 1), key=lambda x: (-ctf[x], x))
    assert ML.fit_counts(df, 1, 5).stages[-1].vocabulary == order[:5]
    assert ML.fit_counts(df, 2, 50).stages[-1].vocabulary == [x for x in order if docs[x] >= 2]
    with pytest.raises(ValueError):
        ML.fit_counts(df, 9)


def test_tree_fits_gather_many_nodes_a_pass_and_walk_no_tree_from_the_root(spark):
    assert ML.estimator("dtree").getMaxMemoryInMB() == ML.TREE_MB > 256
    assert ML.estimator("rforest").getCacheNodeIds()
