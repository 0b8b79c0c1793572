"""Many models in one scan: each equals its model trained alone."""

import random

import numpy as np
import pytest

from tessel.operators import gradient as G
from tessel.operators.experiments import sweep_models


def dense_descent(x, y, share, classes, l2, steps):
    """The same accelerated descent on a dense matrix, one model."""
    v = np.hstack([x, np.ones((len(x), 1))])
    w = ahead = np.zeros((classes, v.shape[1]))
    t = 1.0
    for _ in range(steps):
        s = v @ ahead.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = (p * share[:, None]).T @ v
        g[:, :-1] += l2 * ahead[:, :-1]
        new = ahead - g / (1 + l2)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def test_each_cell_as_if_alone(spark):
    r = np.random.default_rng(2)
    n, d, cells, classes = 240, 15, 3, 3
    x = np.where(r.random((n, d)) < 0.3, r.random((n, d)), 0)
    x[5] = 0
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    y = r.integers(classes, size=n)
    share = np.where(r.random((n, cells)) < 0.6, 1.0, 0.0)
    share /= share.sum(0)
    rows = [(int(y[i]), share[i].tolist(), np.flatnonzero(x[i]).tolist(), x[i][x[i] > 0].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "y int, share array<double>, at array<int>, x array<double>").repartition(4)
    all_ = G.fit_many(df, cells, classes, d, steps=25)
    for c in range(cells):
        assert np.allclose(all_[c], dense_descent(x, y, share[:, c], classes, 1e-3, 25), atol=1e-9)
    alone = spark.createDataFrame([(a, [s[1]], at, v) for a, s, at, v in rows], "y int, share array<double>, at array<int>, x array<double>").repartition(4)
    assert np.allclose(G.fit_many(alone, 1, classes, d, steps=25)[0], all_[1], atol=1e-9)


def test_step_size_does_not_grow_with_partitions(spark, monkeypatch):
    """However many partitions the table has, a step makes some gradients per core, of all classes but the last; slices and few rows of a cell add up."""
    monkeypatch.setattr(G, "ENTRIES_AT_ONCE", 7)
    r = np.random.default_rng(5)
    y, x = r.integers(2, size=100), np.where(r.random((100, 6)) < 0.4, r.random((100, 6)), 0) / 3
    share = np.column_stack([np.full(100, 0.01), np.where(np.arange(100) % 10 == 0, 0.1, 0.0), np.zeros(100)])
    x[:9] = 0
    rows = [(int(y[i]), share[i].tolist(), np.flatnonzero(x[i]).tolist(), x[i][x[i] > 0].tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "y int, share array<double>, at array<int>, x array<double>").repartition(7)
    monkeypatch.setattr(G, "packed", lambda rows, f=G.packed: f(rows).repartition(70))
    sent = []
    monkeypatch.setattr(type(df), "coalesce", lambda self, n, f=type(df).coalesce: sent.append(n) or f(self, n))
    got = G.fit_many(df, 3, 2, 6, steps=12)
    assert sent == [max(16, 2 * spark.sparkContext.defaultParallelism)]
    for c in range(2):
        assert np.allclose(got[c], dense_descent(x, y, share[:, c], 2, 1e-3, 12), atol=1e-9)
    assert not got[2].any() and np.allclose(got.sum(1), 0)
    one = G.gradient(np.zeros((3, 1, 7)), y, share, *[np.array(v) for v in (np.nonzero(x)[1], x[x > 0], np.nonzero(x)[0])])
    assert one.shape == (3, 1, 7) and one[0].any() and one[1].any() and not one[2].any()


def test_sweep_learns(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(40)], k=20) + [f"{'ab'[i % 3 == 0]}{r.randrange(3)}x" for _ in range(4)]), "ab"[i % 3 == 0]) for i in range(240)]
    docs = spark.createDataFrame(rows, "id int, text string, label string").repartition(3)
    got = {x.cell: x for x in sweep_models(docs, [{"train_prop": 0.5}, {"train_prop": 0.5, "cap": 10}, {"train_prop": 0.8}], min_df=2, steps=30).collect()}
    assert [got[i].n_train for i in range(3)] == [120, 20, 192] and [got[i].n_eval for i in range(3)] == [120, 120, 48]
    assert got[0].accuracy == 1.0 and got[2].accuracy == 1.0 and got[1].accuracy > 0.8
