"""Line dedup against every earlier document, without its partner rules."""

import random

from tessel.llm import line_dedup as L


def deleted(spark, rows, **kw):
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **kw).collect()
    return {r.doc_id: (r.text, r.n_deleted) for r in out}


def line(name, words=10):
    return " ".join(f"{name}w{i}" for i in range(words))


def test_the_only_whole_holder_is_met(spark):
    passage = [line(f"p{i}") for i in range(6)]
    rows = [(i, f"{passage[i]}\n{line(f's{i}')}") for i in range(6)] + [(10, "\n".join(passage))]
    rows += [(20 + i, f"{passage[i]}\n{line(f't{i}')}") for i in range(6)] + [(30, "\n".join([line("x"), *passage, line("y")]))]
    got = deleted(spark, rows)
    assert got[30] == (f"{line('x')}\n{line('y')}", 6) and got[10][1] == 0 and sum(n for _, n in got.values()) == 6


def test_runs_cover_every_longer_run():
    r = random.Random(5)
    for _ in range(300):
        words = [r.choice([0, 1, 2, 5, 9, 20, 30]) for _ in range(r.randint(1, 14))]
        hashes = [i + 1 if w or r.random() < 0.3 else 0 for i, w in enumerate(words)]
        got = L.runs(hashes, words, 25)
        assert all(sum(words[s:e]) >= 25 and hashes[s] and hashes[e - 1] for s, e in got)
        for s in range(len(words)):
            for e in range(s + 1, len(words) + 1):
                if hashes[s] and hashes[e - 1] and sum(words[s:e]) >= 25:
                    assert {i for x, y in got if s <= x and y <= e for i in range(x, y)} == set(range(s, e))


def common(a, b, words, block_words):
    """Lines of ``b`` in a run that ``a`` holds too, from every pair of positions."""
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


def test_repeated_and_swapped_passages():
    one, two, x, y, z = [1, 2, 3, 4, 5, 6], [11, 12, 13, 14, 15, 16], [7], [8], [9]
    for a, b, n in (([*x, *one, *y], [*one, *z, *one], 12), ([*one, *x, *one], [*y, *one, *z], 6), ([*one, *x, *two], [*two, *y, *one], 12)):
        assert sum(e - s for s, e in L.blocks(a, b, [10] * len(b), 25)) == n


def test_blocks_against_all_positions():
    r = random.Random(6)
    for _ in range(500):
        size = [0] + [r.choice([0, 1, 3, 7, 12]) for _ in range(6)]
        a, b = (r.choices(range(7), k=r.randint(0, 25)) for _ in range(2))
        words = [size[x] for x in b]
        got = L.blocks(a, b, words, 15)
        assert {i for s, e in got for i in range(s, e)} == common(a, b, words, 15)


def test_against_every_earlier_document(spark):
    r = random.Random(9)
    pool = [" ".join(r.choices("abcdefghij", k=r.choice([1, 2, 5, 6, 9, 14]))) + f" {i}" for i in range(60)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(1, 4)):
            at = r.randrange(55)
            lines += r.choices(pool, k=r.randint(0, 2)) + pool[at:at + r.randint(1, 5)] + r.choices(["", "  "], k=r.randint(0, 2))
        rows.append((i, "\n".join(lines)))
    got = deleted(spark, rows, block_words=15)
    data = [L.line_numbers(t.encode()) for _, t in rows]
    for n, (i, text) in enumerate(rows):
        words = [w if w >= L.LINE_WORDS else 0 for w in data[n][1]]
        gone = set().union(*(common(a, data[n][0], words, 15) for a, _ in data[:n]))
        assert got[i] == ("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone), len(gone))
    assert sum(n for _, n in got.values()) > 100


def test_short_lines_count(spark):
    menu = [line(f"m{i}", 3) for i in range(30)]
    verse = [line(f"v{i}", 1) for i in range(25)]
    rows = [(0, "\n".join(menu)), (1, "\n".join([line("x"), *menu, "", *verse])), (2, "\n".join([*verse[1:], line("y")])), (3, "\n".join(verse))]
    got = deleted(spark, rows)
    assert {i: n for i, (_, n) in got.items()} == {0: 0, 1: 30, 2: 0, 3: 25}
