"""Every stage of the pipeline against a plain version of it, on its real predecessor's rows."""

import random
import zlib

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from test_llm_lines import brute as brute_lines  # noqa: E402
from test_llm_lines import key_of  # noqa: E402
from test_llm_minhash import brute as brute_near  # noqa: E402

from tessel.llm import line_dedup, mixing, quality  # noqa: E402
from tessel.session import scratch_path  # noqa: E402
from tessel.llm.common import stored  # noqa: E402


def tables(spark, path):
    r = random.Random(8)
    vocab = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(900)]
    para = lambda n: " ".join(r.choices(vocab, k=n))
    shared = "\n".join(para(14) for _ in range(4))
    docs = []
    for i in range(150):
        t = "\n".join(para(r.randint(6, 16)) + "." for _ in range(r.randint(1, 6)))
        bad = i % 5 == 0
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif i % 7 == 0:
            t += "\n" + shared
        elif i % 11 == 0 and i > 20:
            words = docs[i - 10][1].split(" ")
            words[r.randrange(len(words))] = "changed"
            t = " ".join(words)
        elif i % 13 == 0 and i > 20:
            t = docs[i - 1 if (i - 1) % 5 else i - 2][1]
        docs.append((i, t, r.choice(["en", "en", "de", None]), r.choice(["src0", "src0", "s1", None]), len(t)))
    docs += [(200, None, "en", "s1", None), (201, "", "en", "s1", 0), (202, "word " * 6000, "fr", "big", 30000), docs[3], docs[4], (None, docs[9][1], "en", "s1", 5)]
    labels = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(0, 150)] + [(150, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_against_plain_versions(spark):
    sf = scratch_path(spark, "pipeline-test-" + str(random.random())[2:])
    tables(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    out = {"in": docs}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stored(stage(spark, list(out.values())[-1], sf), f"test-{name}")
        assert name == "packing" or out[name].columns == docs.columns
    # 1: the scores of each text by the same model, one by one
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), cut=0.3)
    import numpy as np
    keep = [x for x in rows(docs) if model.score(np.array([quality.text_features((x[1] or "").encode())]))[0] >= 0.3]
    assert rows(out["quality"]) == keep
    clean = {x[0] for x in rows(docs) if x[0] is not None and x[0] % 5 and x[0] < 150}
    assert clean <= {x[0] for x in keep} and not {x[0] for x in keep} & {x for x in range(0, 150, 5)}
    # 2: every document against all earlier holders of its lines
    for r in out["quality"].select("doc_id", "text", *line_dedup.key_columns()).collect():
        if r.text is not None:
            key_of[((r.doc_id if r.doc_id is not None else line_dedup.LAST), r.text)] = r.h
    cut = brute_lines([(x[0], x[1]) for x in keep], line_dedup.LINE_WORDS, line_dedup.BLOCK_WORDS)
    want = []
    for x in keep:
        text, _, gone = cut[(x[0] if x[0] is not None else line_dedup.LAST, x[1])] if x[1] is not None else (None, 0, 0)
        if not gone:
            want.append(x)
        elif text.strip():
            want.append((x[0], text, x[2], x[3], len(text)))
    assert rows(out["line_dedup"]) == sorted(want, key=str)
    # 3: one row of each group of the full link graph
    near = brute_near([(x[0], x[1]) for x in want], 5, 80)
    got = rows(out["near_dedup"])
    groups = {c for _, n, c in near if n}
    empty = [x for x in want if not (x[1] or "").split()]
    assert len(got) == len(groups) + len(empty) and set(got) <= set(want)
    assert {x[0] for x in got if (x[1] or "").split()} == groups
    # 4: the SQL version of the budgets; copies are rows
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", got)
    copies = {(a, b, c): n for a, _, b, c, _, n in con.execute(mixing.sql(budget_percent=corpus_pipeline.BUDGET_PERCENT)).fetchall()}
    want4 = [x for x in got for _ in range(copies[(x[0], x[2] or mixing.NONE, x[3] or mixing.NONE)])]
    assert rows(out["mixing"]) == sorted(want4, key=str)
    # 5: exact ids, each in one piece; windows without gaps
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want5 = []
    for x in want4:
        ids = t.encode(x[1] or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            want5.append((x[0], at, len(ids[at:at + 2048]), zlib.crc32(np.array(ids[at:at + 2048], "<u4").tobytes()), len(ids)))
    pieces = out["packing"].collect()
    assert sorted(((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces), key=str) == sorted(want5, key=str)
    for s in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)


def test_empty_tables(spark):
    sf = scratch_path(spark, "pipeline-empty-" + str(random.random())[2:])
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
