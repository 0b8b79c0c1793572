"""Averaged multi-class perceptron by epoch-synchronous parameter mixing.

In each epoch every partition makes one pass of online updates over its rows, starting from the common
weights; the weights of all partitions are then averaged by their rows, in two steps so that no task or driver
receives more than about the square root of the partitions. The answer is the average of the weights over all
updates (each partition keeps it with one extra vector). With one partition this is the
sequential averaged perceptron; with several it still ends without errors on separable data.

Weights are classes x features doubles; the vocabulary bounds them, and they go to the tasks once an epoch.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_pass(weights: np.ndarray, rows) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Weights after a pass over ``rows`` (class, weight, positions, values), their average over it, rows and errors.
    The last column is the bias."""
    w, late, n, errors = weights.copy(), np.zeros_like(weights), 0, 0
    for y, size, at, x in rows:
        s = w[:, at] @ x + w[:, -1]
        p = int(s.argmax())
        if p != y:
            errors += 1
            for c, sign in ((y, 1.0), (p, -1.0)):
                w[c, at] += sign * size * x
                w[c, -1] += sign * size
                late[c, at] += n * sign * size * x
                late[c, -1] += n * sign * size
        n += 1
    return w, w - late / max(1, n), n, errors


def fit(rows: DataFrame, classes: int, features: int, max_iter: int = 50, tol: float = 1e-3) -> tuple[np.ndarray, list[float]]:
    """Averaged weights (classes x (features + 1)) and the share of errors in each epoch. ``rows``: ``y`` (class number), ``w``
    (weight), ``at, x`` (positions and values of a sparse vector), read once an epoch, so a written table. It ends after an epoch
    without errors, or after five that did not lower the share by ``tol``."""
    data = rows.select(F.col("y").cast("int").alias("y"), F.col("w").cast("double").alias("w"), "at", "x")
    parts = max(1, data.rdd.getNumPartitions())
    lanes = math.ceil(math.sqrt(parts))
    shape = (classes, features + 1)
    weights, total, seen, history = np.zeros(shape), np.zeros(shape), 0, []
    spec = "lane int, n long, errors long, w binary, mean binary"
    names = ["lane", "n", "errors", "w", "mean"]

    def record(lane, n, errors, w, mean):
        cols = [pa.array([lane], pa.int32()), pa.array([n], pa.int64()), pa.array([errors], pa.int64()), pa.array([w.tobytes()], pa.binary()),
                pa.array([mean.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=names)

    while len(history) < max_iter:
        start = data.sparkSession.sparkContext.broadcast(weights)

        def learn(batches):
            from pyspark import TaskContext

            def stream():
                for b in batches:
                    for y, w, at, x in zip(*(b.column(i) for i in range(4))):
                        yield y.as_py(), w.as_py(), at.values.to_numpy(zero_copy_only=False), x.values.to_numpy(zero_copy_only=False)

            w, mean, n, errors = one_pass(start.value, stream())
            if n:
                yield record(TaskContext.get().partitionId() % lanes, n, errors, n * w, n * mean)

        def add(batches):
            w, mean, n, errors = np.zeros(shape), np.zeros(shape), 0, 0
            for b in batches:
                for i in range(b.num_rows):
                    n += b.column(1)[i].as_py()
                    errors += b.column(2)[i].as_py()
                    w += np.frombuffer(b.column(3)[i].as_py()).reshape(shape)
                    mean += np.frombuffer(b.column(4)[i].as_py()).reshape(shape)
            if n:
                yield record(0, n, errors, w, mean)

        got = data.mapInArrow(learn, spec).repartition(lanes, "lane").mapInArrow(add, spec).collect()  # about sqrt(partitions) rows
        n, errors = sum(r["n"] for r in got), sum(r["errors"] for r in got)
        start.unpersist()
        if not n:
            return weights, history
        weights = sum(np.frombuffer(r["w"]).reshape(shape) for r in got) / n
        total = total + sum(np.frombuffer(r["mean"]).reshape(shape) for r in got)
        seen += n
        history.append(errors / n)
        if not errors or (len(history) > 5 and min(history[-5:]) > min(history[:-5]) - tol):
            break
    return (weights if not history[-1] else total / seen), history


def predict(rows: DataFrame, weights: np.ndarray, labels: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and ``y_pred`` of rows with ``at, x``."""
    spec = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), "y_pred string"])
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            k = len(keep)
            best = [labels[int((w[:, a.values.to_numpy(zero_copy_only=False)] @ x.values.to_numpy(zero_copy_only=False) + w[:, -1]).argmax())]
                    for a, x in zip(b.column(k), b.column(k + 1))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), pa.array(best, pa.string())], names=[*keep, "y_pred"])

    return rows.select(*keep, "at", "x").mapInArrow(run, spec)
