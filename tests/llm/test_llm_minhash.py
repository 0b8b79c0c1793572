import random
import re

import numpy as np

from tessel.llm import minhash_dedup as M
from tessel.llm.graph import components

SCHEMA = "doc_id long, text string, component_id string, keys int"


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^ \t-\r]+", w)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, groups=25):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = r.choices(vocab, k=60)
    out = []
    for g in range(groups):
        base = r.choices(vocab, k=r.choice([1, 3, 4, 6, 30, 120, 400]))
        if g % 4 == 0:
            base = passage + base[:20]  # a passage that many texts hold
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                t[r.randrange(len(t))] = r.choice(vocab)
            out.append(" ".join(t).upper() if r.random() < 0.2 else "\n".join(t))
    r.shuffle(out)
    return out


def check(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], SCHEMA).repartition(3)
    got = M.near_duplicates(df, **kw).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(texts, kw.get("k", 5), kw.get("percent", 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_against_brute_force(spark):
    rows = [(3 * i, t) for i, t in enumerate(corpus(1))]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a b"), (1004, "A  B"), (1005, "a b c d"), (1006, "a b\x1cc d"),
             (0, rows[0][1]), (3, "another text under the same id"), (None, rows[5][1]), (None, "only null here now ok"), (None, None),
             (2000, " ".join(f"x{i % 9000}" for i in range(60_000)))]
    check(spark, rows, k=4)
    # buckets larger than ``small`` go through blocks
    check(spark, [(i, t) for i, t in enumerate(corpus(2, 12))], k=4, bands=12, rows=3, small=2, salt_rows=2, block_rows=2)


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (3, "other words here now then"), (3, None), (None, ""), (4, ""), (4, ""),
            (None, "only null ids hold this text"), (None, "only null ids hold this text")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in M.one_of_each(df).collect()), key=str)
    assert got == sorted([(1, "A b c d e f"), (3, "other words here now then"), (3, None), (None, ""), (4, ""), (4, ""),
                          (None, "only null ids hold this text")], key=str)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.concatenate([a[:600], np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))])
    s = M.signatures([a, b], 400)
    assert abs((s[0] == s[1]).mean() - 600 / 1200) < 0.08


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(5, x) for x in range(1000, 1400)] + [(1399, 7), (2, 2)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.id: r.component for r in components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 401)}, **{i: 5 for i in [5, 7, *range(1000, 1400)]}}
    assert components(df.limit(0)).count() == 0
