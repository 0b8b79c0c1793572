import duckdb

from tessel.llm import chat_quotes as C

SCHEMA = "conv_id long, turn long, role string, text string, level int, head string"
ROWS = [
    (1, 0, "user", "Hello there\nsecond line of it\n\nA new paragraph"),
    (1, 1, "assistant", "I answer now"),
    (1, 2, "user", "On Monday X wrote:\n> hello   THERE\n> second line of it\nI mean that"),
    (1, 3, "assistant", ">> Hello there\n> I mean that\nok"),
    (1, 4, "user", "no quote here > at all"),
    (1, 5, "user", "> I answer now\nreply to one"),
    (1, 6, "assistant", "follows five"),
    (1, 7, "user", "> reply to one\nnested branch"),
    (1, 8, "user", "> never said\n> nor this"),
    (1, 9, "user", ">hello there second line of it\nrewrapped"),
    (2, 0, "user", "> quotes nothing"), (2, 1, "user", ">"), (2, 5, "user", "a"), (2, 600, "user", "b"), (2, 1300, "user", "> a\nfar"),
    (3, 0, "user", None), (3, 1, None, ""), (3, 1, "user", "same turn"), (3, 2, "user", "> same turn\nyes"), (3, 2, "user", "> same turn\nyes"),
    (None, 1, "user", "> x\nkept"), (4, None, "user", "y"), (None, None, None, None),
]


def run(spark, rows):
    out = C.format_chats(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)).collect()
    return [(r.conv_id, r.turn, r.role, r.text, r.parent_turn, r.quotes, r.position) for r in out]


def test_links_order_and_text(spark):
    got = run(spark, ROWS)
    one = [r for r in got if r[0] == 1]
    assert [(r[1], r[4]) for r in one] == [(0, None), (9, 0), (2, 0), (3, 2), (4, 3), (1, 0), (5, 1), (7, 5), (8, 7), (6, 5)] or \
        {r[1]: r[4] for r in one} == {0: None, 1: 0, 2: 0, 3: 2, 4: 3, 5: 1, 6: 5, 7: 5, 8: 7, 9: 0}
    at = {r[1]: i for i, r in enumerate(one)}
    assert all(at[r[4]] < at[r[1]] for r in one if r[4] is not None)
    text = {r[1]: r[3] for r in one}
    assert text[2] == "I mean that" and text[3] == "ok" and text[4] == "no quote here > at all" and text[8] == ""
    two = {r[1]: r for r in got if r[0] == 2}
    assert two[1300][4] == 5 and two[600][4] == 5 and two[0][4] is None
    assert sum(r[0] == 3 and r[1] == 2 and r[4] == 1 for r in got) == 2
    assert [r[3] for r in got if r[0] is None] == [None, "kept"] and len(got) == len(ROWS)


def sql_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con.execute(C.SQL).fetchall()


DEEP = [(9, 0, "u", "alpha"), (9, 1, "u", "> alpha\nbeta"), (9, 2, "u", "c"), (9, 3, "u", ">> alpha\nd"), (9, 4, "u", ">>> alpha\n>> beta\n> c"), (9, 5, "u", ">>>> beta")]


def test_same_rows_as_sql(spark):
    rows = ROWS + DEEP
    assert sorted(sql_rows(rows), key=str) == sorted(run(spark, rows), key=str)


def test_long_chain_and_long_text(spark):
    rows = [(1, i, "u", (f"> line {i - 2} said\n" if i % 2 else "") + f"line {i} said") for i in range(40)]
    rows += [(2, 0, "u", "w " * 200_000), (2, 1, "u", "> " + "w " * 200_000 + "\nsure")]
    got = {(r[0], r[1]): r for r in run(spark, rows)}
    assert all(got[(1, i)][4] == (i - 2 if i % 2 and i > 1 else i - 1 if i else None) for i in range(40))
    assert got[(2, 1)][3:6] == ("sure", 0, True)


def test_empty_table(spark):
    assert run(spark, []) == []


def preorder(parent, linked):
    """Positions by walking the tree: replies that quote a message first, by turn, then the one that follows."""
    kids = {}
    for t in sorted(parent):
        kids.setdefault(parent[t], []).append(t)
    out, stack = {}, sorted(kids.get(None, []), reverse=True)
    while stack:
        t = stack.pop()
        out[t] = len(out)
        mine = kids.get(t, [])
        stack += reversed([k for k in mine if linked[k]] + [k for k in mine if not linked[k]])
    return out


def test_positions_are_the_preorder(spark):
    import random
    r = random.Random(11)
    rows = []
    for c in range(6):
        turns = sorted(r.sample(range(-700, 2000), 60))
        for i, t in enumerate(turns):
            quoted = r.choice(turns[:i]) if i and r.random() < 0.5 else None
            rows.append((c, t, "u", (f"> said {quoted}\n" if quoted is not None else "") + f"said {t}"))
    got = run(spark, rows)
    for c in range(6):
        mine = {x[1]: x for x in got if x[0] == c}
        assert {t: x[6] for t, x in mine.items()} == preorder({t: x[4] for t, x in mine.items()}, {t: x[5] for t, x in mine.items()})
        assert sum(x[5] for x in mine.values()) > 15
    assert sorted(got, key=str) == sorted(sql_rows(rows), key=str)


def test_chain_of_quoting_messages(spark):
    n = 3000
    got = run(spark, [(1, i, "u", (f"> m{i - 1} of it\n" if i else "") + f"m{i} of it") for i in range(n)])
    assert [(x[1], x[4], x[6]) for x in got] == [(i, i - 1 if i else None, i) for i in range(n)]
