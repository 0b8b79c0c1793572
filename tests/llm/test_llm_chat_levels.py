"""Links by quoted lines of every level."""

import random
import re

from test_llm_chat import run


def parents(spark, rows):
    return {(r[0], r[1]): (r[4], r[5]) for r in run(spark, rows)}


def test_deeper_lines_link_where_level_1_does_not(spark):
    got = parents(spark, [
        (1, 0, "u", "the origin"), (1, 1, "u", "> the origin\nfirst reply"), (1, 2, "u", "apart"),
        (1, 3, "u", ">> the origin\nonly deeper"), (1, 4, "u", "apart again"), (1, 5, "u", "> > > the origin\n"),
        (1, 6, "u", "> apart\n>> the origin\n>> first reply\nlevel 1 decides"), (1, 7, "u", ">> never said"),
        (2, 0, "u", "a"), (2, 1, "u", "b"), (2, 2, "u", ">> a"), (2, 3, "u", ">> a"), (2, 4, "u", "> never\n>>>> a")])
    assert got[1, 3] == (1, True) and got[1, 5] == (3, True) and got[1, 6] == (2, True) and got[1, 7] == (6, False)
    assert got[2, 2] == (0, True) and got[2, 3] == (0, True) and got[2, 4] == (3, True)


def test_against_all_earlier_messages(spark):
    r = random.Random(4)
    rows = [(c, t, "u", "\n".join("> " * r.choice([0, 0, 1, 1, 2, 3, 4, 5, 7]) + r.choice(["one", "line two", "three", "a fourth", "five"])
                                  for _ in range(r.randint(1, 4)))) for c in range(4) for t in range(0, 2400, 60)]
    units = {}
    for c, t, _, text in rows:
        lines = [(x.count(">"), re.sub("[> ]*", "", x, count=1)) for x in text.split("\n")]
        passages = []
        for level, x in lines:
            passages = [*passages[:-1], (level, passages[-1][1] + " " + x)] if passages and passages[-1][0] == level else [*passages, (level, x)]
        units[c, t] = {*lines, *passages}
    got = parents(spark, rows)
    for (c, t), held in units.items():
        sizes = {}
        for level, x in held:
            at = [u for (d, u), other in units.items() if d == c and u < t and any(m < level and y == x for m, y in other)]
            if at:
                sizes[level, max(at)] = sizes.get((level, max(at)), 0) + len(x)
        best = max(((-level, n, u) for (level, u), n in sizes.items()), default=None)
        assert got[c, t] == ((best[2], True) if best else (t - 60 if t else None, False))
    assert sum(quotes for _, quotes in got.values()) > 60
