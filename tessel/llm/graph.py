"""Connected components by contraction, on Spark tables only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import count_rows, stored


class Forest:
    """Union-find that keeps the smallest member as the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def spanning(edges: DataFrame, hold: int = 200_000) -> DataFrame:
    """Replace edges by a spanning forest per ``hold`` nodes of each partition:
    the same components with fewer rows, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def out() -> pa.RecordBatch:
            nodes = list(forest.up)
            return pa.RecordBatch.from_arrays([pa.array([forest.root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
            if len(forest.up) > hold:
                yield out()
                forest = Forest()
        yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of every node of ``edges`` (a, b: long).

    Each round maps every node to the smallest of itself and its neighbours, follows that map
    to its end (by doubling, so a chain of n nodes takes log n joins), and rewrites the edges by
    it; equal ends vanish. An edge between a node and what it maps to turns into an edge between
    equal images, so nothing gets disconnected, the smallest node maps to itself, and at least
    half of the nodes are gone after a round. Rounds end when no edge is left. The maps, written
    to the shared folder, are then composed. The aggregation combines before its shuffle;
    joins on a hub's id are plain equi-joins that adaptive execution may split.
    """
    live = stored(spanning(edges.where(F.col("a") != F.col("b"))), "edges")
    maps: list[DataFrame] = []
    while count_rows(live):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
                      .select("id", F.least("id", "to").alias("to")), "steps")
        while True:
            on = step.select(F.col("id").alias("to"), F.col("to").alias("end"))
            moved = stored(step.join(on, "to").select("id", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "steps")
            step = moved.select("id", "to")
            if not count_rows(moved.where("moved")):
                break
        maps.append(step)
        left = step.select(F.col("id").alias("a"), F.col("to").alias("na"))
        right = step.select(F.col("id").alias("b"), F.col("to").alias("nb"))
        live = stored(spanning(live.join(left, "a").join(right, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).where("a != b")), "edges")
    if not maps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    comp = maps[-1].select("id", F.col("to").alias("component"))
    for step in reversed(maps[:-1]):
        # an image without a row of its own had no edge left: it is the component
        later = comp.select(F.col("id").alias("to"), "component")
        comp = step.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    return stored(comp, "components")


def pair_arrays(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
