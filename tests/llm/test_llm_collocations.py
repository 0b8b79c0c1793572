import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessel.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, n long, words string"


def brute(rows, max_words, min_count, per_lang=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in cand.items():
        score, cut = min((10 ** 6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [b for (g, q), b in cand.items() if g == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if all(100 * b < 50 * a for b in longer):
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    got, rank = [], Counter()
    for lang, s, a, p, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= per_lang:
            got.append((lang, rank[lang], p.decode(), -a, l, r, total[lang], -s))
    return got


def corpus():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["É", "a\x00b", "x y", "z"]
    rows = []
    for _ in range(60):
        words = r.choices(vocab, weights=[1 / (i + 1) for i in range(len(vocab))], k=r.randint(1, 90))
        rows.append((r.choice([" ", "  ", "\t"]).join(w + r.choice([""] * 6 + [".", ",", "\n", "?"]) for w in words), r.choice(["en", "en", "en", None, "und", "fr"])))
    rows += [("New York City " * 15, "en"), ("One. Two " * 12, "fr"), (None, "en"), ("", "de"), (" .,\n", "de"), ("a a a a a a a a a a a a a", "es"), ("x" * 3000 + " y", "xx")]
    return rows + rows[:3]


@pytest.mark.parametrize("max_words,min_count,block_words", [(3, 10, C.BLOCK_WORDS), (3, 4, 40), (4, 5, 7)])
def test_against_counting_every_phrase(spark, max_words, min_count, block_words, monkeypatch):
    if block_words < 100:
        monkeypatch.setattr(C, "BUCKET_PAIRS", 64)  # many buckets
    rows = corpus()
    df = spark.createDataFrame([(i, t, g, 7, "clash") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    got = C.collocations(df, max_words, min_count, block_words=block_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, max_words, min_count)
    assert len(want) > 20
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if max_words == 3:
        top = C.collocations(df, max_words, min_count, per_lang=3, block_words=block_words)
        assert sorted(map(tuple, top.collect())) == sorted(brute(rows, max_words, min_count, 3))


def test_sql_says_the_same(spark):
    rows = corpus()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, g) for i, (t, g) in enumerate(rows)])
    assert sorted(con.execute(C.SQL).fetchall()) == sorted(brute(rows, 3, 10))


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, 1, "")], SCHEMA)).count() == 0


def test_exact_beyond_64_bits(spark):
    a = 3 * 10 ** 11
    df = spark.createDataFrame([(a, [a + 1, a], [a + 7, a])], "f long, prefix array<long>, suffix array<long>")
    assert df.select(C.weakest_cut(2).alias("c")).first().c.score == 10 ** 6 * a * a // ((a + 1) * (a + 7))


@pytest.mark.parametrize("tile,dense", [(4, 3), (8, 10 ** 9), (2, 1), (512, 100)])
def test_tiles_dense_and_sparse(tile, dense):
    r = np.random.default_rng(1)
    left, right = r.zipf(1.4, 4000) % (1 << 40), r.zipf(1.2, 4000) % 90
    a, b, n, which = C.count_pairs(left, right, tile, dense)
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(left.tolist(), right.tolist()))
    assert (a[which] == left).all() and (b[which] == right).all()


def test_chunks_are_the_whole_text():
    r = random.Random(2)
    raw = "".join(r.choices("ab .,\t", k=3000)).encode() + b"c" * 500 + b" d"
    whole = [w for w, _ in C.chunks(raw, 1 << 30)]
    for size in (1, 7, 64):
        parts = list(C.chunks(raw, size))
        assert [x for w, _ in parts for x in w] == whole[0]
        assert all(w[-1:] == [b"."] for w, done in parts[:-1] if done)
