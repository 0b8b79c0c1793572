import math

import numpy as np

from tessel.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def brute(rows, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 100 == 0:
            c = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(c)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(420)]
    rows += [(500 + i, rows[100][1]) for i in range(15)]  # ties
    rows += [(600, None), (700, [1.0, None] * 4), (800, [float("nan")] * 8), (900, [0.0] * 8), (1000, [1.0, 2.0]), (1001, [2.0, 2.0]),
             (None, [1.0] * 8), (1100, []), (1200, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    for chunk in (37, 8192):
        got = topk.top_k_search(df, topk.multiples_as_queries(df), 10, chunk=chunk, query_block=4).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 10)
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k_search(empty, empty).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [3e12, -1.0]), (1, [2e12, 5.0]), (2, [2e12, 4.0]), (3, [-1e30, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    got = topk.top_k_search(df, topk.multiples_as_queries(df), 2).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])][:2] == [1, 2]
