import random
import re

from tessel.llm import licenses as L

SCHEMA = "doc_id long, text string, spans string, labels int"
ORIGINAL = "Released under\nthe  MIT-License. (Apache License, Version 2.0) — cc-by-nc!"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def best_distance(notice, text):
    """Least edits between the notice and any substring (row by row)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def damage(r, notice, edits):
    t = list(notice)
    for _ in range(edits):
        i = r.randrange(len(t))
        kind = r.randrange(3)
        if kind == 0:
            t[i] = r.choice("abcxyz é")
        elif kind == 1:
            del t[i]
        else:
            t.insert(i, r.choice("abcxyz "))
    return "".join(t)


def expected(text):
    w = words(text)
    places = [(i, n) for n in L.BASE for i in range(len(w)) if w[i:i + len(n.words.split())] == n.words.split()]
    joined = f" {' '.join(w)} "
    based = {n.label for _, n in places}
    found = {n.label: 1 - best_distance(n.words, joined) / len(n.words) for n in sorted(L.FUZZY, key=lambda n: -best_distance(n.words, joined) / len(n.words))
             if best_distance(n.words, joined) <= n.errors}
    score = 1.0 if places else max(found.values(), default=0.0)
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(based)), ",".join(sorted(based | set(found))), score)


def test_against_every_substring(spark):
    r = random.Random(5)
    pool = "the gnu license of a under public terms mit source cc by nc general version 2 é".split()
    texts = [None, "", "\x00 .,", ORIGINAL, "cc by nc cc by nc cc by ncx", "under the mit license under the mit license", "cc by NC cc by nc",
             "undr the mit licence", "und er the m i t license", "version 2 apache license", "permission", "İ under the MIT license"]
    for n in L.FUZZY:
        for edits in range(n.errors + 3):
            texts.append(" ".join(r.choices(pool, k=6)) + " " + damage(r, n.words, edits) + " " + " ".join(r.choices(pool, k=6)))
            texts.append(damage(r, n.words, edits).upper())
    texts += [" ".join(r.choices(pool, k=80)) for _ in range(20)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, ORIGINAL, "", 0), (None, ORIGINAL, "", 0)]
    got = L.scan(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == L.COLUMNS.names
    got = got.collect()
    assert len(got) == len(rows)
    for g in got:
        text = ORIGINAL if g.doc_id is None else texts[g.doc_id]
        assert tuple(g)[1:8] == expected(text), text
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spans_lie_in_the_original_text():
    f = L.Finder(L.BASE + L.FUZZY)
    raw = ORIGINAL.encode()
    text = f" {b' '.join(L.split_words(raw)).decode()} "
    spans = [(n, s + 1, e - 1) if (L.BASE + L.FUZZY)[n].base else (n, s, e) for n, s, e, _ in f.find(text)]
    got = [ORIGINAL[a:b] for a, b in L.place(ORIGINAL, [(s, e) for _, s, e in spans])]
    assert got.count("under\nthe  MIT-License") == 2 and got.count("Apache License, Version 2") == 2 and "cc-by-nc" in got


def test_long_text_and_shared_windows():
    long = "x " * 200_000 + "under the mit licens" + " the gnu " * 50_000 + "cc by nc"
    f = L.Finder(L.BASE + L.FUZZY)
    hits = f.find(f" {b' '.join(L.split_words(long.encode())).decode()} ")
    assert {(f.notices[n].label, c) for n, _, _, c in hits} == {("mit", 1), ("cc-by-nc", 0)}
    assert len(f.seen) < 2000
