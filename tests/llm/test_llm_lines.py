import random

from tessel.llm import line_dedup as L

SCHEMA = "doc_id long, text string, cut string, key int, d int"


def shared_lines(a, b, words, block_words):
    """Lines of ``b`` in a run that ``a`` holds too, from every pair of positions (blank lines are '')."""
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            at = [k for k in range(j, j + n) if b[k]]
            if sum(words[k] for k in at) >= block_words:
                gone |= set(range(at[0], at[-1] + 1))
    return gone


def brute(rows, line_words, block_words):
    """All documents against every earlier one; lines are equal when their words are."""
    docs = sorted({((i if i is not None else L.LAST), t) for i, t in rows if t is not None}, key=lambda x: (x[0], key_of[x]))
    data = [[b" ".join(x.split()) for x in t.encode().split(b"\n")] for _, t in docs]
    cut = {}
    for n, x in enumerate(docs):
        words = [len(w.split()) if len(w.split()) >= line_words else 0 for w in data[n]]
        gone = set().union(*(shared_lines(a, data[n], words, block_words) for a in data[:n]))
        lines = x[1].split("\n")
        cut[x] = (x[1] if not gone else "\n".join(t for i, t in enumerate(lines) if i not in gone), len(lines), len(gone))
    return cut


key_of = {}


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    for r in df.select("doc_id", "text", *L.key_columns()).collect():
        if r.text is not None:
            key_of[((r.doc_id if r.doc_id is not None else L.LAST), r.text)] = r.h
    want = brute(rows, kw.get("line_words", L.LINE_WORDS), kw.get("block_words", L.BLOCK_WORDS))
    out = L.dedup_lines(df, **kw)
    assert out.columns == ["doc_id", "text", "cut", "key", "d", "n_lines", "n_deleted"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in out.collect()), key=str)
    exp = sorted(((i, *(want[(i if i is not None else L.LAST, t)] if t is not None else (None, 0, 0))) for i, t in rows), key=str)
    assert got == exp
    return got


def test_against_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(r.choices("abcdefghij", k=r.choice([1, 2, 5, 6, 9, 14]))) + f" {i}" for i in range(120)]
    rows = []
    for i in range(90):
        lines = r.choices(pool, k=r.randint(1, 8))
        for _ in range(r.randint(0, 2)):
            at = r.randrange(110)
            lines += pool[at:at + r.randint(1, 6)] + r.choices(["", "  "], k=r.randint(0, 2))
        rows.append((i, "\n".join(lines)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (None, rows[3][1]), (5, rows[6][1]), (7, rows[7][1]), (300, None), (301, ""), (302, "\n\n"),
             (303, "\n".join(pool[10:60] * 40)), (304, pool[0] + "\r\n" + pool[1])]
    got = check(spark, rows, line_words=4, block_words=15)
    assert sum(x[3] for x in got) > 100
    check(spark, [(1, None), (2, "")])


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_patience_alignment():
    assert L.patience([1, 2, 3, 4], [9, 1, 2, 8, 4]) == [(0, 1), (1, 2), (3, 4)]
    assert L.patience([5, 5, 1], [5, 1, 5]) in ([(0, 0), (2, 1)], [(1, 0), (2, 1)], [(0, 0), (1, 2)], [(0, 0), (2, 1)])
    assert L.blocks([1, 0, 2, 7], [3, 1, 0, 2], [9, 9, 0, 9], 18) == [(1, 4)]
    assert L.blocks([1, 2], [1, 3, 2], [9, 9, 9], 18) == []


def test_a_passage_goes_from_all_but_the_earliest(spark):
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(9)) for i in range(7))
    rows = [(i, f"own line {i} of some words\n{passage}\nlast own line {i} here") for i in range(30)]
    out = {x.doc_id: x.text for x in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in out[0] and all(passage not in out[i] and f"own line {i} of" in out[i] for i in range(1, 30))


def test_alignment_decides(spark, monkeypatch):
    """Deletions come from the aligner alone: without it nothing goes."""
    shared = [(5, [0, 9], [3], [4]), (7, [4], [0, 8], [1, 9])]
    assert L.aligned_blocks(shared) == [(0, 1), (3, 4), (8, 9)]
    monkeypatch.setattr(L, "align", lambda a, b: [])
    assert L.aligned_blocks(shared) == []


def test_rounds():
    assert L.align([1, 2, 3], [3, 1, 2, 2, 9]) == [0, 1, 2, 3]
    assert L.align([1, 1], [1, 1, 1]) == [0, 1, 2]
    assert L.align([], [1]) == []


def test_taken_names(spark):
    df = spark.createDataFrame([(1, "a\n" * 30, 5, 6, 7, 8)], "doc_id long, text string, n_lines int, N_Deleted int, __d int, cut int")
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines_", "n_deleted_"]
    assert tuple(out.first())[2:] == (5, 6, 7, 8, 31, 0)
