"""Argmax over class scores, flattening, chi-square, nearest neighbours."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from tessel.operators import features as FE
from tessel.operators import similarity as SI
from tessel.operators.experiments import flatten_json
from tessel.operators.metrics import NO_LABEL, NO_PRED, argmax_label, classification_report


def test_argmax_and_marks(spark):
    rows = [(1, {"b": 0.5, "a": 0.5}), (2, {"a": -3.0, "c": -1.0}), (3, {}), (4, None), (5, {"a": None, "b": float("nan"), "c": -9.0}), (6, {"a": None})]
    df = spark.createDataFrame(rows, "id int, s map<string,double>").select("id", argmax_label(F.col("s"), NO_PRED).alias("y"))
    got = dict(df.collect())
    assert got[1] in ("a", "b") and [got[i] for i in range(2, 7)] == ["c", NO_PRED, NO_PRED, "c", NO_PRED]
    rep = {r.label: r.support for r in classification_report(spark.createDataFrame([("a", "a"), (None, "a"), (None, None)], "y_true string, y_pred string")).collect()}
    assert rep["a"] == 1 and rep[NO_LABEL] == 2


def flat(v, path=""):
    out = {}
    for k, x in v.items():
        if isinstance(x, dict):
            out |= flat(x, f"{path}{k}.")
        else:
            out[path + k] = None if x is None else x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))
    return out


def test_flatten(spark):
    docs = [{"a": 1, "b": {"c": {"d": "x", "e": [1, {"f": 2}]}, "g": {}}, "h": None}, {}, {"a.b": {"c": True}}, {"deep": {"r": {"s": {"t": {"u": 1.5}}}}}]
    texts = [json.dumps(d) for d in docs] + ["not json", "[1]", "3", None, ""]
    got = {}
    for r in flatten_json(spark.createDataFrame(list(enumerate(texts)), "id int, j string"), "j", ["id"]).collect():
        got.setdefault(r.id, {})[r.key] = r.value
    assert got == {i: flat(d) for i, d in enumerate(docs) if d}


def test_chi2_by_hand(spark):
    r = random.Random(2)
    labels = [(i, r.choice(["a", "b", "c"])) for i in range(60)]
    w = [(i, f"t{t}", r.random()) for i, _ in labels for t in range(12) if r.random() < 0.4] + [(0, "only", 0.7)]
    got = {x.term: x.chi2 for x in FE.chi2_terms(spark.createDataFrame(w, "id int, term string, w double"), spark.createDataFrame(labels, "id int, label string")).collect()}
    y = dict(labels)
    for term, c in got.items():
        total = sum(v for _, t, v in w if t == term)
        want = 0
        for lab in "abc":
            e = total * sum(v == lab for v in y.values()) / len(y)
            want += (sum(v for i, t, v in w if t == term and y[i] == lab) - e) ** 2 / e
        assert abs(c - want) < 2e-6
    assert len(FE.chi2_terms(spark.createDataFrame(w, "id int, term string, w double"), spark.createDataFrame(labels, "id int, label string"), 3).collect()) == 3


def test_nearest_neighbours_by_hand(spark):
    r = np.random.default_rng(4)
    x = np.where(r.random((90, 40)) < 0.15, r.random((90, 40)), 0)
    x[5] = x[7] = x[9]
    x[:, :2] = 0
    x[80] = 0
    x[80, 0] = 1.0  # shares no term
    x = x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    rows = [(i, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, t array<int>, wt array<double>").repartition(3)
    sims = np.round(x @ x.T, 9)
    want = []
    for i in range(90):
        best = sorted((-s, j) for j, s in enumerate(sims[i].tolist()) if j != i and s > 0)[:5]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(best)]
    for block, terms in ((256, 4096), (13, 7)):
        got = SI.top_neighbours(df, 5, block, terms).collect()
        assert sorted((g.id, g["rank"], g.neighbour) for g in got) == want
