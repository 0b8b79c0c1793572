"""Exact top-k inner-product search with vector-approximation files.

Every component becomes floor(scale * x). Vectors are gathered into chunks and stored as two tables: the exact
integers, and the approximation file, which holds per vector one small cell number per dimension (equal-width
cells between the chunk's bounds in that dimension).

1. Blocks of queries scan the cells of every chunk, and nothing else. One product of queries and cell corners gives all scores up to
   two constants a query and chunk, hence a lower and an upper bound of every score. A chunk yields each query's k best
   lower bounds and the vectors whose upper bound reaches the kth of them.
2. The kth best lower bound over *all* chunks discards most of these.
3. Exact vectors are joined for what is left and read in order of their upper bound until no unread bound can reach the
   kth result. Ties go to the smaller id, so a bound equal to the kth score is still read.

Distribution: query blocks (a stated set: rows whose id is a multiple of
``query_modulus``) meet each chunk by an equi-join on (dimension, chunk); what a pair yields are bounds. A query's
survivors stream through one task, which holds its best k.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; rows with the query's own id are not its candidates; vectors of
another length are not comparable; every query row is answered, so repeated ids
give repeated answers; null ids take no part. Scores are integers; a score
beyond 64 bits saturates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import stored

CHUNK, QUERY_BLOCK, CELLS = 8192, 512, 64


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in float64 (exact: scale is a power of two)."""
    return np.floor(x.astype(np.float64) * scale)


def usable(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(id, matrix rows) of valid vectors, grouped by their length."""
    for i, v in zip(ids.to_pylist(), vectors.to_pylist()):
        if i is None or not v or any(c is None for c in v):
            continue
        a = np.asarray(v, dtype=np.float64)
        if np.isfinite(a).all():
            yield i, a


def gather(df: DataFrame, rows: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """Chunks of at most ``rows`` vectors of one dimension: ``key, dim, n, ids, data``."""
    schema = pa.schema([("key", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = TaskContext.get().partitionId() << 32, {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal key
            ids, data = zip(*held.pop(dim))
            key += 1
            rec = [key, dim, len(ids), np.array(ids, "<i8").tobytes(), quantised(np.stack(data), scale).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(rec, schema)], schema=schema)

        for b in batches:
            for i, a in usable(b.column(0), b.column(1)):
                held.setdefault(len(a), []).append((i, a))
                if len(held[len(a)]) >= rows:
                    yield out(len(a))
        for dim in list(held):
            yield out(dim)

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).mapInArrow(
        run, "key long, dim int, n int, ids binary, data binary")


class ApproximationFile:
    """Cell numbers of a chunk and the cells' bounds per dimension."""

    def __init__(self, low: np.ndarray, width: np.ndarray, cell: np.ndarray):
        self.low, self.width, self.cell = low, width, cell

    @classmethod
    def of(cls, exact: np.ndarray, cells: int = CELLS) -> ApproximationFile:
        low, high = exact.min(0), exact.max(0)
        width = np.maximum(np.ceil((high - low + 1) / cells), 1.0)
        return cls(low, width, np.minimum((exact - low) // width, 255).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper score bounds (queries x vectors) from cells alone: the score of a cell's lower corner, and
        what the rest of the cell may add to or take from it."""
        corner = (queries * self.width) @ self.cell.T.astype(np.float64) + (queries @ self.low)[:, None]
        rest = self.width - 1
        return corner + (np.minimum(queries, 0) @ rest)[:, None], corner + (np.maximum(queries, 0) @ rest)[:, None]


def approximate(chunks: DataFrame, cells: int) -> DataFrame:
    """The approximation file of ``gather``'s chunks: ``key, dim, n, ids, low, width, cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                dim, n = r.column(1)[0].as_py(), r.column(2)[0].as_py()
                va = ApproximationFile.of(np.frombuffer(r.column(4)[0].as_py()).reshape(n, dim), cells)
                yield pa.RecordBatch.from_arrays([*r.columns[:4], *(pa.array([x.tobytes()], pa.binary()) for x in (va.low, va.width, va.cell))],
                                                 names=["key", "dim", "n", "ids", "low", "width", "cell"])

    return chunks.mapInArrow(run, "key long, dim int, n int, ids binary, low binary, width binary, cell binary")


def single_vectors(chunks: DataFrame) -> DataFrame:
    """Chunks taken apart: ``key, at, id, v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, dim, n, ids, data = (b.column(c)[i].as_py() for c in range(5))
                yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.frombuffer(ids, "<i8")),
                                                  pa.array([data[8 * dim * j:8 * dim * (j + 1)] for j in range(n)], pa.binary())], names=["key", "at", "id", "v"])

    return chunks.mapInArrow(run, "key long, at int, id long, v binary")


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of float64 integers, exact at any size."""
    if not len(v) or np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, len(q)) < 2 ** 53:
        return (v @ q).astype(np.int64)
    top = 2 ** 63 - 1
    qi = [int(x) for x in q]
    return np.array([max(-top - 1, min(top, sum(a * int(b) for a, b in zip(qi, row)))) for row in v], dtype=np.int64)


def chunk_bounds(va: ApproximationFile, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray,
                 k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query with candidates in the chunk: its number, the k best lower bounds, and places and upper bounds of the vectors
    that may be among the chunk's k best."""
    lower, upper = va.bounds(queries)
    slack = 1e-9 * max(1.0, float(np.abs(lower).max(initial=0)), float(np.abs(upper).max(initial=0)))  # float sums of large integers
    for j in range(len(queries)):
        other = np.flatnonzero(ids != query_ids[j])
        if not len(other):
            continue
        low, up = lower[j, other] - slack, upper[j, other] + slack
        best = np.partition(low, len(low) - k)[-k:] if len(low) > k else low
        near = up >= (best.min() if len(low) >= k else -np.inf)
        yield j, best, other[near], up[near]


def best_of(query: np.ndarray, got: list[tuple[int, int]], ids: list[int], vectors: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(-score, id) of the k best so far and some more vectors."""
    return sorted(got + [(-s, i) for s, i in zip(exact_scores(query, vectors).tolist(), ids)])[:k]


def top_k_search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id",
                 vector_col: str = "embedding", chunk: int = CHUNK, query_block: int = QUERY_BLOCK, cells: int = CELLS, step: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest integer inner products."""
    exact = stored(gather(vectors, chunk, scale, id_col, vector_col), "exact")
    va = stored(approximate(exact, cells), "va")
    q = stored(gather(queries, query_block, scale, id_col, vector_col), "queries")
    # chunk numbers come from the stored table; a row is a whole chunk, so this list of keys is short
    keys = va.select(F.col("dim").alias("kd"), F.col("key").alias("vkey"))
    pairs = (q.withColumnsRenamed({"key": "qkey", "n": "qn", "ids": "qids", "data": "qdata"})
             .join(keys, F.col("dim") == F.col("kd")).drop("kd"))
    met = pairs.repartition("dim", "vkey").join(va.withColumnRenamed("key", "vkey"), ["dim", "vkey"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(c)[i].as_py() for c, name in enumerate(b.schema.names)}
                qs, qids = np.frombuffer(r["qdata"]).reshape(r["qn"], r["dim"]), np.frombuffer(r["qids"], "<i8")
                file = ApproximationFile(np.frombuffer(r["low"]), np.frombuffer(r["width"]), np.frombuffer(r["cell"], np.uint8).reshape(r["n"], r["dim"]))
                cols: list[list] = [[], [], [], []]
                for j, best, at, up in chunk_bounds(file, qids, qs, np.frombuffer(r["ids"], "<i8"), k):
                    cols[0].append(np.full(len(best) + len(at), j, np.int32))
                    cols[1].append(np.concatenate([np.zeros(len(best), np.int32), np.ones(len(at), np.int32)]))
                    cols[2].append(np.concatenate([np.full(len(best), -1), at]).astype(np.int32))
                    cols[3].append(np.concatenate([best, up]))
                if cols[0]:
                    n = sum(map(len, cols[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["qkey"])), pa.array(np.full(n, r["vkey"])), *(pa.array(np.concatenate(c)) for c in cols)],
                                                     names=["qkey", "key", "qat", "kind", "at", "bound"])

    found = stored(met.select("dim", "vkey", "qkey", "qn", "qids", "qdata", "n", "ids", "low", "width", "cell").mapInArrow(
        scan, "qkey long, key long, qat int, kind int, at int, bound double"), "bounds")
    w = Window.partitionBy("qkey", "qat").orderBy(F.desc("bound"))
    kth = (found.where("kind = 0").withColumn("no", F.row_number().over(w)).where(F.col("no") <= k)
           .groupBy("qkey", "qat").agg(F.when(F.count(F.lit(1)) == k, F.min("bound")).alias("kth")))
    left = found.where("kind = 1").join(kth, ["qkey", "qat"]).where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    asks = single_vectors(q).select(F.col("key").alias("qkey"), F.col("at").alias("qat"), F.lit(0).alias("role"), F.lit(0.0).alias("bound"), "id", "v")
    rows = left.join(single_vectors(exact), ["key", "at"]).select("qkey", "qat", F.lit(1).alias("role"), "bound", "id", "v").unionAll(asks)
    rows = rows.repartition("qkey", "qat").sortWithinPartitions("qkey", "qat", "role", F.desc("bound"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, query, got, wait, done, number = None, None, [], [], False, 0

        def answer():
            nonlocal got
            if wait:
                got = best_of(query, got, [i for i, _, _ in wait], np.stack([v for _, v, _ in wait]), k)
                wait.clear()

        def result():
            answer()
            return [(asked, number, i + 1, v, -s) for i, (s, v) in enumerate(got)]

        for b in batches:
            out = []
            for role, bound, i, v in zip(*(b.column(c).to_pylist() for c in range(4))):
                if role == 0:
                    if query is not None:
                        out += result()
                    asked, query, got, done, number = i, np.frombuffer(v), [], False, number + 1
                elif not done:
                    if len(wait) >= step:
                        answer()
                        # no unread bound can reach the kth result
                        done = len(got) >= k and bound < -got[k - 1][0]
                    if not done:
                        wait.append((i, np.frombuffer(v), bound))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in ((0, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64()))],
                                                 names=["query_id", "rank", "vec_id", "score"])
        if query is not None:
            out = result()
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in ((0, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64()))],
                                             names=["query_id", "rank", "vec_id", "score"])

    return rows.select("role", "bound", "id", "v").mapInArrow(read, "query_id long, rank int, vec_id long, score long")


def multiples_as_queries(vectors: DataFrame, modulus: int = 100, id_col: str = "vec_id") -> DataFrame:
    return vectors.where(F.pmod(F.col(id_col), F.lit(modulus)) == 0)
