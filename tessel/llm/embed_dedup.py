"""Embedding near-duplicates by hierarchical navigable small-world graphs (HNSW).

Equal vectors of one label form a class first. The classes of a label are dealt
by hash to shards of about ``shard_rows``; each shard gets an HNSW graph (built in
batches with numpy: nodes of the upper layers first, neighbours chosen for diversity,
reverse links pruned the same way), once, and the graphs are stored. Every shard's graph is then queried with all classes of
its label: a beam search down the layers finds entry links, and the search
spreads from every link found to its graph neighbours until no further vector
reaches the threshold, so the number of links of a vector is not bounded by the beam.
An audit draws queries and compares them with the whole shard until ``AUDIT_LINKS`` links to other
vectors are seen; while the search finds less than ``audit_recall`` of them, the beam is doubled. Where
all queries hold fewer links than that, reading them was an exact scan already and its links are the result; where
even a beam as wide as the shard fails the audit, the pair of shards is scanned exactly.
All links are verified by cosine in double precision.

What leaves a task is linear in its vectors: per class the number of vectors linked
with it, and a spanning forest of the links; pairs are never emitted. Degrees are
summed, forests are united into components.

Distribution: a graph is one row; it streams into a task ahead of up to ``MEET_SHARDS`` shards of vectors that query it
(links are symmetric, so each pair of shards meets once). A hot label has many shards, and exact copies
are one row whatever their number.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, rows with a null label or a null id, link with nothing; vectors of
different length never link. Rows are vectors: a repeated row is one more copy. A vector without links
is its own component and kept. Extra columns are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import stored
from tessel.llm.graph import Forest, components

SHARD_ROWS = 8192
NEIGHBOURS, BUILD_BEAM, BEAM, BATCH = 16, 64, 32, 256
AUDIT_ROWS, AUDIT_RECALL, AUDIT_LINKS = 64, 0.995, 64
MEET_SHARDS = 8
THRESHOLD = 0.93


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Layer:
    """One graph layer over a subset of the nodes: ``near[node]`` holds neighbour numbers, -1 for none."""

    def __init__(self, x: np.ndarray, most: int):
        self.x, self.most = x, most
        self.near = np.full((len(x), most), -1, np.int32)

    def beam(self, q: np.ndarray, entry: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` nodes (and similarities, descending) found from each query's entries."""
        m, n = len(q), len(self.x)
        seen = np.zeros((m, n), bool)
        rows = np.arange(m)[:, None]
        ids = np.full((m, width), -1, np.int32)
        sim = np.full((m, width), -np.inf, np.float32)
        done = np.ones((m, width), bool)
        e = entry[:, :width]
        ok = e >= 0
        sim[:, :e.shape[1]] = np.where(ok, np.einsum("med,md->me", self.x[e], q), -np.inf)
        ids[:, :e.shape[1]] = e
        done[:, :e.shape[1]] = ~ok
        seen[np.broadcast_to(rows, e.shape)[ok], e[ok]] = True
        live = np.arange(m)
        while len(live):
            s = np.where(done[live], -np.inf, sim[live])
            pick = np.argpartition(-s, min(at_once, width) - 1, axis=1)[:, :at_once] if width > at_once else np.tile(np.arange(width), (len(live), 1))
            good = np.take_along_axis(s, pick, 1) > -np.inf
            some = good.any(1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            done[live[:, None], pick] = True
            nb = self.near[np.where(good, ids[live[:, None], pick], 0)]
            nb = np.where(good[:, :, None], nb, -1).reshape(len(live), -1)
            nb.sort(1)  # the same neighbour of two nodes counts once
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            fresh = (nb >= 0) & ~seen[live[:, None], nb]
            r, c = np.nonzero(fresh)
            seen[live[r], nb[r, c]] = True
            new = np.full(nb.shape, -np.inf, np.float32)
            new[r, c] = np.einsum("kd,kd->k", self.x[nb[r, c]], q[live[r]])
            all_sim = np.concatenate([sim[live], new], 1)
            best = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
            sim[live] = np.take_along_axis(all_sim, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, nb, -1)], 1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), best, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def diverse(self, q: np.ndarray, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Per row up to ``most`` candidates (descending), each nearer to the query
        than to those taken before it; free places are filled with the nearest others."""
        m, c = ids.shape
        taken = np.full((m, most), -1, np.int32)
        count = np.zeros(m, np.int64)
        skipped = np.zeros((m, c), bool)
        vec = np.zeros((m, most, q.shape[1]), np.float32)
        for j in range(c):
            can = (ids[:, j] >= 0) & (count < most)
            x = self.x[ids[:, j]]
            close = np.einsum("mtd,md->mt", vec, x)
            close[np.arange(most)[None, :] >= count[:, None]] = -np.inf
            take = can & (close.max(1) < sim[:, j])
            skipped[:, j] = can & ~take
            r = np.flatnonzero(take)
            taken[r, count[r]] = ids[r, j]
            vec[r, count[r]] = x[r]
            count[r] += 1
        for j in range(c):
            r = np.flatnonzero(skipped[:, j] & (count < most))
            taken[r, count[r]] = ids[r, j]
            count[r] += 1
        return taken

    def insert(self, nodes: np.ndarray, entry: np.ndarray, beam: int) -> None:
        """Add a batch: candidates are the graph's nodes by beam search, and the batch itself."""
        q = self.x[nodes]
        ids, sim = self.beam(q, entry, beam)
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        k = min(len(nodes), beam)
        near = np.argpartition(-own, k - 1, axis=1)[:, :k]
        ids = np.concatenate([ids, nodes[near].astype(np.int32)], 1)
        sim = np.concatenate([sim, np.take_along_axis(own, near, 1)], 1)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        ids[sim == -np.inf] = -1
        half = max(4, self.most // 2)
        chosen = self.diverse(q, ids, sim, half)
        self.near[nodes, :half] = chosen
        # reverse links, pruned by the same rule
        r, c = np.nonzero(chosen >= 0)
        order = np.argsort(chosen[r, c], kind="stable")
        to, frm = chosen[r, c][order], nodes[r][order]
        targets, first = np.unique(to, return_index=True)
        last = np.append(first[1:], len(to))
        widest = int((last - first).max(initial=0)) + self.most
        cand = np.full((len(targets), widest), -1, np.int64)
        cand[:, :self.most] = self.near[targets]
        for i, (a, b) in enumerate(zip(first, last)):
            cand[i, self.most:self.most + b - a] = frm[a:b]
        cand.sort(1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        full = (cand >= 0).sum(1) > self.most
        cand = -np.sort(-cand, 1)
        self.near[targets[~full]] = cand[~full, :self.most]
        t, cand = targets[full], cand[full]
        for at in range(0, len(t), 512):
            tt, cc = t[at:at + 512], cand[at:at + 512]
            s = np.where(cc >= 0, np.einsum("mcd,md->mc", self.x[cc], self.x[tt]), -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")
            cc, s = np.take_along_axis(cc, order, 1), np.take_along_axis(s, order, 1)
            self.near[tt] = self.diverse(self.x[tt], cc.astype(np.int32), s, self.most)


class Hnsw:
    """Layers from the top down; layer 0 holds all nodes."""

    def __init__(self, x: np.ndarray, neighbours: int = NEIGHBOURS, build_beam: int = BUILD_BEAM, batch: int = BATCH, seed: int = 1):
        self.x = x.astype(np.float32)
        n = len(x)
        u = np.random.default_rng(seed).random(n)
        self.level = np.minimum(6, (-np.log(1 - u) / math.log(neighbours)).astype(int))
        self.order = np.argsort(-self.level, kind="stable")
        self.top = int(self.level.max(initial=0))
        self.layers: list[Layer] = []
        for lv in range(self.top, -1, -1):
            layer = Layer(self.x, neighbours * (2 if lv == 0 else 1))
            nodes = self.order[:int((self.level >= lv).sum())]
            at = 1  # the first node needs no links
            while at < len(nodes):
                part = nodes[at:at + min(batch, at)]
                entry = self.descend(self.x[part])
                inside = np.zeros(n, bool)
                inside[nodes[:at]] = True
                entry = np.where((entry >= 0) & inside[entry], entry, -1)
                entry = np.concatenate([entry, np.full((len(part), 1), nodes[0])], 1).astype(np.int32)
                layer.insert(part, entry, build_beam)
                at += len(part)
            self.layers.append(layer)

    def dump(self) -> bytes:
        """Levels and the neighbours of each layer's own nodes; ``load`` needs the vectors besides."""
        out = io.BytesIO()
        near = {f"near{i}": y.near[self.order[:int((self.level >= self.top - i).sum())]] for i, y in enumerate(self.layers)}
        np.savez(out, level=self.level, order=self.order, **near)
        return out.getvalue()

    @classmethod
    def load(cls, x: np.ndarray, raw: bytes) -> Hnsw:
        self, z = cls.__new__(cls), np.load(io.BytesIO(raw))
        self.x, self.level, self.order = x.astype(np.float32), z["level"], z["order"]
        self.top = int(self.level.max(initial=0))
        self.layers = []
        for i in range(self.top + 1):
            near = z[f"near{i}"]
            layer = Layer(self.x, near.shape[1])
            layer.near[self.order[:len(near)]] = near
            self.layers.append(layer)
        return self

    def descend(self, q: np.ndarray, width: int = 4) -> np.ndarray:
        """Entry nodes for the layer below those built so far."""
        entry = np.full((len(q), 1), self.order[0], np.int32)
        for layer in self.layers:
            entry = layer.beam(q, entry, width)[0]
        return entry

    def links(self, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs at or above the threshold, verified in double precision."""
        q32 = q.astype(np.float32)
        base = self.layers[-1]
        entry = np.full((len(q), 1), self.order[0], np.int32)
        for layer in self.layers[:-1]:
            entry = layer.beam(q32, entry, 4)[0]
        ids, sim = base.beam(q32, entry, min(beam, len(self.x)))
        least = np.float32(threshold) - np.float32(1e-5)
        seen = np.zeros((len(q), len(self.x)), bool)
        hit = np.zeros_like(seen)
        r, c = np.nonzero(sim >= least)
        v = ids[r, c]
        seen[r, v] = True
        while len(r):  # spread from every link to its neighbours
            hit[r, v] = True
            nb = base.near[v]
            r, v = np.repeat(r, nb.shape[1]), nb.ravel()
            ok = v >= 0
            r, v = r[ok], v[ok]
            ok = ~seen[r, v]
            key = np.unique(r[ok].astype(np.int64) * len(self.x) + v[ok])
            r, v = key // len(self.x), key % len(self.x)
            seen[r, v] = True
            s = np.concatenate([np.einsum("kd,kd->k", self.x[v[i:i + 65536]], q32[r[i:i + 65536]]) for i in range(0, len(r), 65536)] or [np.empty(0)])
            r, v = r[s >= least], v[s >= least]
        return np.nonzero(hit)


def exact_links(x: np.ndarray, q: np.ndarray, rows: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of some queries by comparing them with all vectors; in a shard queried with itself, without those to themselves."""
    hit = (q[rows] @ x.T) >= threshold
    if same:
        hit[np.arange(len(rows)), rows] = False
    a, v = np.nonzero(hit)
    return rows[a], v


def shard_links(graph: Hnsw, x: np.ndarray, q: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM, audit_rows: int = AUDIT_ROWS,
                audit_recall: float = AUDIT_RECALL, block: int = BATCH, same: bool = False,
                audit_links: int = AUDIT_LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, int, float]]:
    """Verified links of the queries, after the audits pass: (query, node, beam, recall); beam 0 is an exact scan."""
    order = np.random.default_rng(7).permutation(len(q))
    truth, at, links = [], 0, 0
    while at < len(q) and links < audit_links:
        truth.append(exact_links(x, q, order[at:at + audit_rows], threshold, same))
        links += len(truth[-1][0])
        at += audit_rows
    if at >= len(q):  # every query was compared with every vector
        yield from ((a, v, 0, 1.0) for a, v in truth)
        return
    audit = np.sort(order[:at])
    known = np.concatenate([a * len(x) + v for a, v in truth])
    while True:
        got = []
        for lo in range(0, len(audit), block):
            a, v = graph.links(q[audit[lo:lo + block]], threshold, beam)
            got.append(audit[lo:lo + block][a] * len(x) + v)
        recall = float(np.isin(known, np.concatenate(got)).mean())
        if recall >= audit_recall or beam >= len(x):
            break
        beam *= 2
    for lo in range(0, len(q), block):
        rows = np.arange(lo, min(lo + block, len(q)))
        if recall < audit_recall:
            yield (*exact_links(x, q, rows, threshold, same), 0, 1.0)
            continue
        a, v = graph.links(q[rows], threshold, beam)
        keep = np.einsum("kd,kd->k", q[rows[a]], x[v]) >= threshold if len(a) else np.zeros(0, bool)
        yield rows[a[keep]], v[keep], beam, recall


def vectors_of(data: bytes, dim: int) -> np.ndarray:
    return unit(np.frombuffer(data).reshape(-1, dim))


def graphs(shards: DataFrame) -> DataFrame:
    """``shards`` with each one's graph, built here and nowhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                graph = Hnsw(vectors_of(row.column(5)[0].as_py(), row.column(1)[0].as_py())).dump()
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([graph], pa.binary())], names=[*row.schema.names, "graph"])

    spec = "label string, dim int, shard int, ids binary, weights binary, data binary"
    return shards.select("label", "dim", "shard", "ids", "weights", "data").repartition("label", "dim", "shard").mapInArrow(run, f"{spec}, graph binary")


def link_classes(shards: DataFrame, threshold: float, audit_recall: float) -> DataFrame:
    """``shards``: one row per shard (label, dim, shard, ids, weights, data, graph). Returns
    ``kind, a, b``: kind 0 = class a has b linked vectors in other classes; kind 1 = forest edge a - b."""
    last = shards.groupBy("label", "dim").agg(F.max("shard").alias("last"))
    # every shard's graph (role 0) meets the vectors of its own and every later shard of its label (role 1), some at a time
    turn = lambda s: F.floor(F.col(s) / MEET_SHARDS).cast("int")
    held = (shards.join(last, ["label", "dim"]).withColumn("at", F.explode(F.sequence(turn("shard"), turn("last"))))
            .select("label", "dim", "shard", "at", F.lit(0).alias("role"), F.col("shard").alias("s2"), "ids", "weights", "data", "graph"))
    asks = (shards.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("shard")))).withColumn("at", turn("shard"))
            .select("label", "dim", F.col("first").alias("shard"), "at", F.lit(1).alias("role"), F.col("shard").alias("s2"), "ids", "weights", "data",
                    F.lit(None).cast("binary").alias("graph")))
    keys = ["label", "dim", "shard", "at"]
    met = held.unionAll(asks).repartition(*keys).sortWithinPartitions(*keys, "role", "s2").select("dim", "shard", "role", "s2", "ids", "weights", "data", "graph")

    def links(graph, x1, i1, w1, x2, i2, w2, same):
        deg1, deg2, forest = np.zeros(len(i1), np.int64), np.zeros(len(i2), np.int64), Forest()
        mine = np.zeros((len(i1), len(i1)), bool) if same else None
        for q, v, _, _ in shard_links(graph, x1, x2, threshold, audit_recall=audit_recall, same=same):
            if same:
                mine[q, v] = True
                continue
            np.add.at(deg2, q, w1[v])
            np.add.at(deg1, v, w2[q])
            tree(forest, i2, i1, q, v)
        if same:  # a link found from either end counts for both
            mine |= mine.T
            np.fill_diagonal(mine, False)
            for at in range(0, len(i1), 256):
                deg1[at:at + 256] += mine[at:at + 256] @ w1
                q, v = np.nonzero(mine[at:at + 256])
                tree(forest, i1, i1, q + at, v)
        some1, some2 = np.flatnonzero(deg1), np.flatnonzero(deg2)
        up = np.fromiter(forest.up, np.int64, len(forest.up))
        root = np.array([forest.root(x) for x in up.tolist()], np.int64)
        kind = np.concatenate([np.zeros(len(some1) + len(some2), np.int32), np.ones(len(up), np.int32)])
        return pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(np.concatenate([i1[some1], i2[some2], root])),
             pa.array(np.concatenate([deg1[some1], deg2[some2], up]))], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for i in range(b.num_rows):
                dim, s1, role, s2, ids, weights, data, graph = (b.column(c)[i].as_py() for c in range(8))
                ids, weights, x = np.frombuffer(ids, "<i8"), np.frombuffer(weights, "<i8"), vectors_of(data, dim)
                if role == 0:
                    held = (Hnsw.load(x, graph), x, ids, weights)
                else:
                    yield links(*held, x, ids, weights, s1 == s2)

    return met.mapInArrow(run, "kind int, a long, b long")


def tree(forest: Forest, left: np.ndarray, right: np.ndarray, q: np.ndarray, v: np.ndarray) -> None:
    """Add links to the forest."""
    for a, b in zip(left[q].tolist(), right[v].tolist()):
        if a != b:
            forest.join(a, b)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, audit_recall: float = AUDIT_RECALL,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``."""
    src = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                         F.col(label_col).cast("string").alias("label"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, label = [], b.column(2).to_pylist()
            for i, v, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), label):
                d = None
                if i is not None and g is not None and v and not any(c is None for c in v):
                    a = np.array(v)
                    if np.isfinite(a).all() and a.any():
                        d = xxhash.xxh3_64_intdigest((a + 0.0).tobytes() + g.encode()) - (1 << 63)
                out.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())], names=["id", "v", "label", "class"])

    rows = stored(src.mapInArrow(digest, "id long, v array<double>, label string, class long"), "vectors")
    # a class is named by its digest; its vector is that of any member
    classes = stored(rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
        .withColumn("dim", F.size("v")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("class"), F.col("shards")).cast("int"))

    def shard(key, table):
        t = table.sort_by("class")
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"label": [key[0].as_py()], "dim": pa.array([key[1].as_py()], pa.int32()), "shard": pa.array([key[2].as_py()], pa.int32()),
                         "ids": [t.column("class").to_numpy().astype("<i8").tobytes()], "weights": [t.column("copies").to_numpy().astype("<i8").tobytes()],
                         "data": [np.ascontiguousarray(flat, np.float64).tobytes()]})

    shards = stored(dealt.select("label", "dim", "shard", "class", "copies", "v").groupBy("label", "dim", "shard").applyInArrow(
        shard, "label string, dim int, shard int, ids binary, weights binary, data binary"), "shards")
    shards = stored(graphs(shards), "graphs")
    found = stored(link_classes(shards, threshold, audit_recall), "found")
    comp = components(found.where("kind = 1").select("a", "b"))
    degree = found.where("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("others"))
    of = (classes.join(comp.withColumnRenamed("id", "class"), "class", "left").join(degree, "class", "left")
          .select("class", "least", F.coalesce("component", "class").alias("component"),
                  (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = stored(of.join(least, "component").select("class", "n_links", "component_id"), "groups")
    out = rows.select("id", "class").join(groups, "class", "left")
    cid = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), cid.alias("component_id"),
                      F.col("id").eqNullSafe(cid).alias("kept"))
