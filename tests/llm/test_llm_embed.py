import numpy as np

from tessel.llm import embed_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, shard int"


def brute(rows, thr):
    ok = [i for i, (d, v, g) in enumerate(rows) if d is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = {i: i for i in range(len(rows))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    n = [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(np.float32(rows[i][1]), np.float64) for i in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= thr:
                    n[a] += 1
                    n[b] += 1
                    up[root(a)] = root(b)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, n[i], least.get(root(i))) for i, (d, _, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(500):
        v = base[i % 60 if i % 3 else 0] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.5])
        rows.append((i, [float(x) for x in np.float32(v)], [1, 1, 1, 2][i % 4]))
    rows += [(1000 + i, rows[0][1], 1) for i in range(40)] + [(2000, rows[0][1], 2), (7, rows[0][1], 1), (7, rows[0][1], 1)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [1.0, None] * 8, 1),
             (3005, rows[0][1], None), (None, rows[0][1], 1), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1), (3008, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(a, b, c, "clash", 3) for a, b, c in rows], SCHEMA).repartition(3)
    want = brute(rows, 0.93)
    for size in (8192, 100):
        got = E.near_duplicates(df, 0.93, shard_rows=size).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_audit_widens_the_beam():
    rng = np.random.default_rng(4)
    x = E.unit(rng.normal(size=(300, 8)))
    g = E.Hnsw(x, neighbours=4, build_beam=4)
    out = list(E.shard_links(g, x, x, threshold=0.5, beam=1, audit_rows=300, audit_recall=1.0))
    hit = np.zeros((300, 300), bool)
    for q, v, beam, recall in out:
        hit[q, v] = True
    assert recall == 1.0 or beam >= 300
    assert hit.sum() >= 0.99 * (x @ x.T >= 0.5).sum() and not (hit & ~(x @ x.T >= 0.5 - 1e-9)).any()


def test_linked_and_unlinked_shards(spark):
    """Many shards a label: half of the vectors have near copies in other shards, the others none."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(250, 24))
    linked = np.repeat(base, 4, 0) + rng.normal(size=(1000, 24)) * 0.1
    x = np.concatenate([rng.normal(size=(1000, 24)), linked]).astype(np.float32)
    rows = [(i, v.tolist(), int(i >= 1000), "", 0) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), shard_rows=100).collect()}
    u = E.unit(x.astype(np.float64))
    for part in (np.arange(1000), np.arange(1000, 2000)):
        near = u[part] @ u[part].T >= 0.93
        assert [got[i][0] for i in part.tolist()] == (near.sum(1) - 1).tolist()
        assert (near.sum() - len(part) > 1000) == bool(part[0])


def test_audits_see_links_to_others():
    """Without links among different vectors no beam grows: the audit itself is the exact scan."""
    x = E.unit(np.random.default_rng(5).normal(size=(2000, 32)))
    g = E.Hnsw(x)
    out = list(E.shard_links(g, x, x, same=True))
    assert {beam for _, _, beam, _ in out} == {0} and sum(len(q) for q, *_ in out) == 0
    twin = np.concatenate([x, E.unit(x + 0.01)])
    got = list(E.shard_links(E.Hnsw(twin), twin, twin, same=True))
    assert min(beam for _, _, beam, _ in got) >= E.BEAM and min(r for *_, r in got) >= E.AUDIT_RECALL


def test_a_stored_graph_is_the_graph():
    x = E.unit(np.random.default_rng(3).normal(size=(700, 12)))
    g = E.Hnsw(x)
    h = E.Hnsw.load(x, g.dump())
    assert len(h.layers) == len(g.layers) and all((a.near == b.near).all() for a, b in zip(g.layers, h.layers))
