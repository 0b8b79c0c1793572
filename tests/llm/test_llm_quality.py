import random

import numpy as np
import pytest

from tessel.llm import quality as Q

SCHEMA = "doc_id long, text string, quality string, score double"


def corpus(n, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(800)]
    out = []
    for i in range(n):
        words = r.choices(vocab, k=r.randint(5, 200))
        bad = r.random() < 0.3
        if bad:
            kind = r.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "***" for w in words] if kind == 1 else [w for w in words[:6] for _ in range(9)]
        out.append((i, " ".join(words) + ".", 0 if bad else 1))
    return out


def test_held_out_accuracy_and_edges(spark):
    train, test = corpus(400, 1), [(i + 1000, t, q) for i, t, q in corpus(300, 2)]
    edge = [(5000, None, 1), (5001, "", 1), (5002, "ß" * 300_000, 1), (None, "null id", 1), (5003, train[0][1], 1), (5003, train[0][1], 1)]
    docs = spark.createDataFrame([(i, t, "clash", 0.0) for i, t, _ in train + test + edge], SCHEMA)
    labels = spark.createDataFrame([(i, q) for i, _, q in train] + [(7, None), (None, 1), (999999, 0)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    got = Q.score(docs, model).collect()
    assert len(got) == len(train + test + edge) and got[0].quality == "clash"
    by = {r.doc_id: r.quality_score for r in got}
    assert all(0 <= s <= 1 for s in by.values())
    hit = np.mean([(by[i] >= Q.CUT) == (q == 1) for i, _, q in test])
    assert hit >= 0.95
    assert len({r.quality_score for r in got if r.doc_id == 5003}) == 1
    assert Q.score(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        Q.score(docs, model, "score")


def test_one_class_only_gives_the_constant_score(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    for labels in ([(1, 1)], []):
        m = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r.quality_score for r in Q.score(docs, m).collect()} == {Q.NO_MODEL}


def test_weights_against_plain_gradient_descent():
    """The same loss on the same pairs, by small steps down its gradient, pair by pair; and the quantile by sorting."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    good = (x @ np.array([2.0, -1.0, 0.0]) + rng.normal(size=60)) > 0
    pairs = list(zip(*Q.preference_pairs(good)))
    assert {i for i, _ in pairs} == set(np.flatnonzero(good)) and {j for _, j in pairs} == set(np.flatnonzero(~good))
    w = [0.0, 0.0, 0.0]
    for _ in range(3000):
        grad = [1e-2 * v for v in w]
        for i, j in pairs:
            d = x[i] - x[j]
            p = 1 / (1 + np.exp(d[0] * w[0] + d[1] * w[1] + d[2] * w[2]))
            for c in range(3):
                grad[c] -= p * d[c] / len(pairs)
        w = [v - 0.8 * g for v, g in zip(w, grad)]
        if max(map(abs, grad)) < 1e-7:
            break
    assert np.allclose(Q.bradley_terry(x, good), w, atol=1e-4)
    m = Q.QualityModel(x, good)  # three surface measures only
    scores = sorted(m.raw(x).tolist())
    k = round(60 * float((~good).mean()))
    assert m.threshold == (scores[k - 1] + scores[k]) / 2
    s = m.score(x)
    assert ((s >= Q.CUT) == (m.raw(x) >= m.threshold)).all() and sum(s < Q.CUT) == k


def test_faults_of_wording_are_learned(spark):
    """Bad documents look like the others but for some of their words."""
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    rows = []
    for i in range(900):
        bad = r.random() < 0.4
        words = r.choices(vocab, k=60)
        if bad:
            for _ in range(8):
                words[r.randrange(60)] = r.choice(["casino", "jackpot", "freespin"])
        rows.append((i, " ".join(words) + ".", int(not bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([(i, q) for i, _, q in rows if i < 600], "doc_id long, quality int"))
    by = {x.doc_id: x.quality_score for x in Q.score(docs, model).collect()}
    assert np.mean([(by[i] >= Q.CUT) == (q == 1) for i, _, q in rows if i >= 600]) >= 0.93


def test_the_sample_is_cut_by_count(spark):
    docs = spark.createDataFrame([(1, f"text {i} of one id") for i in range(300)] + [(i, "other text here") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 200 + [(1, 0)] * 200 + [(i, i % 2) for i in range(2, 60)], "doc_id long, quality int")
    seen = []
    make = Q.QualityModel

    class Counted(make):
        def __init__(self, x, good, *rest):
            seen.append(len(x))
            super().__init__(x, good, *rest)
    Q.QualityModel = Counted
    try:
        Q.fit(docs, labels, sample_rows=100)
    finally:
        Q.QualityModel = make
    assert seen[0] <= 100


def test_the_fit_reads_every_labelled_row(spark, monkeypatch):
    """The weights, threshold and slope over several chunks are those of one matrix of all rows with the same pairs."""
    rows = corpus(700, 9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    sampled = Q.fit(docs, labels, sample_rows=10_000)
    whole = Q.fit(docs, labels)  # one chunk: the same pairs
    assert np.allclose(whole.w, sampled.w, atol=1e-4) and abs(whole.threshold - sampled.threshold) < 1e-3
    assert np.allclose(whole.mean, sampled.mean, atol=1e-6) and np.allclose(whole.scale, sampled.scale, rtol=1e-4)
    seen, make = [], Q.chunked

    def small(found):
        seen.append(make(found, 100))
        return seen[-1]
    monkeypatch.setattr(Q, "chunked", small)
    monkeypatch.setattr(Q, "CHUNK_LEAST", 8)
    many = Q.fit(docs, labels)
    parts = seen[0].collect()
    assert len(parts) == 7 and sum(len(r.good) for r in parts) == 700 and sum(len(r.x) for r in parts) == 700 * Q.N_FEATURES * 4
    s = sorted(many.raw(np.concatenate([np.frombuffer(r.x, "<f4").reshape(-1, Q.N_FEATURES) for r in parts])).tolist())
    k = round(700 * sum(q == 0 for _, _, q in rows) / 700)
    assert abs(many.threshold - (s[k - 1] + s[k]) / 2) < 1e-4 and abs(many.slope - 4 / np.std(s)) < 1e-3


def test_queries_fold_null_ids_and_types(spark):
    """The registered queries of languages and quality: folds by crc32 of the id, null ids, column types."""
    import zlib

    from tessel.llm.queries import QUERIES
    from tessel.session import scratch_path
    path = scratch_path(spark, f"folds-{random.random()}")
    rows = [(i, f"the words of text {i} and some more", ["en", "fr", None][i % 3], "s") for i in range(80)] + [(None, "no id here", "en", None), (90, None, "en", "s"), (91, "½", "fr", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    for name, folds, left_out, types in (("op1_language_id", 4, 2, {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
                                         ("op4_quality", 5, 0, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})):
        out = QUERIES[name](spark, path)
        assert {c: t for c, t in out.dtypes if c in types} == types
        got = out.collect()
        assert sorted((str(r.doc_id) for r in got)) == sorted(str(r[0]) for r in rows)
        for r in got:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == left_out)
            assert 0 <= r.score <= 1
        if name == "op1_language_id":
            assert {r.doc_id: r.lang_pred for r in got}[90] == "und" and {r.doc_id: r.lang_pred for r in got}[91] == "und"
        else:
            assert all(r.predicted == int(r.score >= 0.3) for r in got)
