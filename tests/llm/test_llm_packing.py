import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessel.llm import packing  # noqa: E402

SCHEMA = "doc_id long, text string, shard string, row int, start int"
TEXTS = ["", None, "Hello, World.  don't stop", "ÉTÉ naïve café 123 0 0 x0y", "a.b c, d. ,. <|endoftext|> !!..",
         "\x0b\x1c tab nbsp 　wide", "word " * 5000, "Ered*** is%%% this,*** ok?.", "it's we'll I'd 's 't", "́a é ẛ̣"]


def exact(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_pieces_and_sequences(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "y", 1, 1), (None, "null id", "", 0, 0)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("word_bpe_49k.json"), shard_pieces=6).collect()
    ids = exact(TEXTS)
    for i, want in enumerate(ids):
        got = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in got) == len(want) * (2 if i == 2 else 1)
        for r in got:
            piece = np.array(want[r.start:r.start + r.length], "<u4").tobytes()
            assert (r.doc_tokens, r.ids_crc32) == (len(want), zlib.crc32(piece))
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_best_fit_decreasing_against_a_list():
    rng = np.random.default_rng(3)
    for cap in (10, 64, 2048):
        n = rng.integers(1, cap + 1, 400)
        w, off = packing.best_fit_decreasing(n, cap)
        left: list[int] = []
        for i in np.argsort(-n, kind="stable"):
            fits = [x for x in left if x >= n[i]]
            if fits:
                k = left.index(min(fits))
                left[k] -= n[i]
            else:
                left.append(cap - n[i])
        assert sorted(left) == sorted(cap - n[w == k].sum() for k in range(w.max() + 1))


def test_cache_restart_gives_the_same_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    small = packing.WordEncoder(path, cache_words=3)
    texts = [(t or "").encode() for t in TEXTS]
    for part in (texts[:4], texts[4:], texts):
        small.encode(part)
    assert [len(x) // 4 + 1 for x in small.encode(texts)] == [len(x) for x in exact(TEXTS)]
