"""Many linear classifiers in one shared scan.

A sweep trains the same kind of model on many subsets of one table. Here every row carries a weight per
cell (0: not in the cell's training rows), and a pass over the table gives the gradients of all
cells at once; the step is accelerated gradient descent on the softmax loss with a ridge, whose step length is known
beforehand for vectors of at most unit length. A cell's model is the one it would get if trained alone.

From zero weights, the weights of all classes always sum to zero, so those of all classes but the last are stepped.
Gradients are (cells * (classes - 1)) x (features + 1) doubles; some tasks per core make one each, whatever the number of
partitions, and these are added in two steps, so that no task or driver receives more than about the square root of them.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import scratch_path

#: Entries of the sparse rows that a task holds as arrays at a time.
ENTRIES_AT_ONCE = 1 << 18


def flat(column: pa.Array, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, or of one of :func:`packed` with values of ``kind``, and the number of them in each row."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // np.dtype(kind).itemsize
        return np.frombuffer(column.buffers()[2] or b"", kind)[ends[0]:ends[-1]], np.diff(ends)
    size = np.diff(column.offsets.to_numpy()) if isinstance(column, pa.ListArray) else np.array([len(x) for x in column.to_pylist()])
    return column.flatten().to_numpy(zero_copy_only=False), size


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` (``y, share, at, x``), written with the lists ``at`` and ``x`` as bytes: Spark passes them on whole, not number by number."""
    def pack(values, size):
        ends = np.concatenate([[0], np.cumsum(size) * values.itemsize]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                (at, n), (x, m) = flat(b.column(2)), flat(b.column(3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pack(at.astype(np.int32), n), pack(x.astype(np.float64), m)], names=["y", "share", "at", "x"])

    path = scratch_path(rows.sparkSession, f"packed-{uuid.uuid4().hex[:12]}")
    rows.select(F.col("y").cast("int").alias("y"), "share", "at", "x").mapInArrow(run, "y int, share array<double>, at binary, x binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def class_scores(weights: np.ndarray, at: np.ndarray, x: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """rows x len(weights) scores of sparse rows."""
    out = np.empty((rows, len(weights)))
    for k, w in enumerate(weights):
        out[:, k] = np.bincount(owner, weights=x * w[at], minlength=rows) + w[-1]
    return out


def gradient(weights: np.ndarray, y: np.ndarray, share: np.ndarray, at: np.ndarray, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Gradient of the weighted softmax losses of all cells, for all classes but the last (``weights``: cells x (classes - 1) x (features + 1));
    ``share`` is rows x cells. A cell reads its own rows only, where it has few."""
    g = np.zeros_like(weights)
    for c, w in enumerate(weights):
        own = share[:, c] != 0
        rows, a, v, o = own.sum(), at, x, owner
        if not rows:
            continue
        if 2 * rows < len(y):
            keep = own[owner]
            a, v, o = at[keep], x[keep], (np.cumsum(own) - 1)[owner[keep]]
        else:
            own[:] = True
        s = class_scores(w, a, v, o, own.sum())
        s = np.column_stack([s, -s.sum(1)])
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), y[own]] -= 1.0
        r = p * share[own, c][:, None]
        for k in range(len(w)):
            g[c, k, :-1] = np.bincount(a, weights=v * r[:, k][o], minlength=w.shape[1] - 1)
            g[c, k, -1] = r[:, k].sum()
    return g


def batches_of(batches, columns: int):
    """Slices of some rows: the leading columns as arrays, then owner, positions and values of the sparse vectors."""
    for batch in batches:
        ends, lo = np.cumsum(flat(batch.column(columns), np.int32)[1]), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ENTRIES_AT_ONCE, side="right")))
            b = batch.slice(lo, hi - lo)
            lo = hi
            at, size = flat(b.column(columns), np.int32)
            x, _ = flat(b.column(columns + 1))
            yield [b.column(i) for i in range(columns)], np.repeat(np.arange(b.num_rows), size), at.astype(np.int64), x


def fit_many(rows: DataFrame, cells: int, classes: int, features: int, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (cells x classes x (features + 1)). ``rows``: ``y`` (class number), ``share`` (array: the row's weight in each cell, of sum 1
    per cell), ``at, x``; written once more for the steps, each of which reads all."""
    sc = rows.sparkSession.sparkContext
    data = packed(rows)
    tasks = min(max(1, data.rdd.getNumPartitions()), max(16, 2 * sc.defaultParallelism))
    data = data.coalesce(tasks)
    lanes = math.ceil(math.sqrt(tasks))
    shape = (cells, classes - 1, features + 1)
    w, ahead, t = np.zeros(shape), np.zeros(shape), 1.0
    rate = 1.0 / (1.0 + l2)  # softmax curvature 1/2 times a squared length of at most 2, the bias included
    for _ in range(steps if classes > 1 else 0):
        now = sc.broadcast(ahead)

        def one(batches):
            from pyspark import TaskContext
            g = np.zeros(shape)
            for (y, share), owner, at, x in batches_of(batches, 2):
                g += gradient(now.value, y.to_numpy(), flat(share)[0].reshape(len(y), cells), at, x, owner)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % lanes], pa.int32()), pa.array([g.tobytes()], pa.binary())], names=["lane", "g"])

        def add(batches):
            g = np.zeros(shape)
            for b in batches:
                for v in b.column(1):
                    g += np.frombuffer(v.as_py()).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([g.tobytes()], pa.binary())], names=["lane", "g"])

        spec = "lane int, g binary"
        got = data.mapInArrow(one, spec).repartition(lanes, "lane").mapInArrow(add, spec).collect()  # about sqrt(tasks) rows
        g = sum((np.frombuffer(r["g"]).reshape(shape) for r in got), np.zeros(shape))
        now.unpersist()
        g[..., :-1] += l2 * ahead[..., :-1]
        new = ahead - rate * g
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return np.concatenate([w, -w.sum(1, keepdims=True)], 1)


def predict_many(rows: DataFrame, weights: np.ndarray, labels: list[str]) -> DataFrame:
    """``cell, y_true, y_pred``: a row for each cell in which a row is judged. ``rows``: ``label, judged`` (array of booleans, one a cell), ``at, x``."""
    cells, classes = weights.shape[:2]
    shared = rows.sparkSession.sparkContext.broadcast(weights.reshape(cells * classes, -1))

    def run(batches):
        for (label, judged), owner, at, x in batches_of(batches, 2):
            n = len(label)
            best = class_scores(shared.value, at, x, owner, n).reshape(n, cells, classes).argmax(2)
            i, c = np.nonzero(flat(judged)[0].reshape(n, cells))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), label.cast(pa.string()).take(pa.array(i)),
                                                  pa.array(labels, pa.string()).take(pa.array(best[i, c]))], names=["cell", "y_true", "y_pred"])

    return rows.select("label", "judged", "at", "x").mapInArrow(run, "cell int, y_true string, y_pred string")
