import hashlib
import heapq
import random
import re
import zlib

import duckdb

from tessel.llm import chat_repair as R
from tessel.llm.chat_repair_sql import sql

SCHEMA = "conv_id long, turn long, role string, text string, seq int, audit string"
TARGET = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, letters) by a search over prefixes of rows and of role initials; ``rows`` are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, made, lines = heapq.heappop(heap)
        state = made if len(made) < 2 else ("s" if made[0] == "s" and len(made) == 1 else "") + made[-1]
        if i == len(rows) and TARGET.fullmatch(made):
            return cost, letters, "\n".join(lines)
        if (letters, i, made) in done or len(made) > 2 * len(rows) + 3:
            continue
        done.add((letters, i, made))

        def go(c, x, j, initial, line):
            if initial and not any(TARGET.fullmatch(made + initial + rest) for rest in ("", "a", "ua")):
                return
            heapq.heappush(heap, (cost + c, letters + x, j, made + initial, lines + ((line,) if line is not None else ())))

        for role in ("user", "assistant"):
            go(2, "I", i, role[0], f"{role}:")
        if i < len(rows):
            role, text, fault = rows[i]
            go(3, "D", i + 1, "", None)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    go(more, "K", i + 1, role[0], f"{role}:{text}")
                for new in ("user", "assistant"):
                    go(2 + more, "R", i + 1, new[0], f"{new}:{text}")


def brute(table):
    out, by = [], {}
    for c, t, role, text in table:
        by.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c, rows in by.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = {t for t, *_ in rows if t is not None}
        faults, seen = [], set()
        for _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, letters, text = cheapest([(r, x, f) for (_, r, x), f in zip(rows, faults)])
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed=1, convs=60):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "user "]
    texts = ["Yes.", "No", "what?", " \t\n", "", None, "Ünd so!\r\n", "a:b", "done. \x0b", "x" * 500]
    rows = []
    for c in [*range(convs), None]:
        for t in range(r.randint(1, 7)):
            turn = r.choice([t, t, t, t, None, t + 5, 0])
            rows.append((c, turn, r.choice(roles[:5] * 3 + roles), r.choice([f"line {c} {t}."] * 6 + texts)))
    rows += [(500, 1, "user", "Same.")] * 3 + [(501, None, None, None)] * 2 + [(502, 2 ** 62, "user", "Far."), (502, -5, "system", "Near.")]
    gone = next(c for c in range(600, 10 ** 6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "All rows of this conversation are dropped.")]


def spread(spark, rows):
    return spark.createDataFrame([(*x, 9, "clash") for x in rows], SCHEMA).repartition(3)


def test_against_search(spark):
    rows = table()
    want = brute(rows)
    assert len({w[7] for w in want}) > 20 and any(w[7] == "" for w in want)
    for segment in (R.SEGMENT, 2):
        got = R.repair(spread(spark, rows), segment)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_sql_says_the_same():
    rows = table(2)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(sql())
    assert [c[0] for c in cur.description] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(cur.fetchall(), key=str) == brute(rows)


def test_segments_of_a_long_conversation(spark):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant"]), f"{r.choice(['Yes', 'No', t])}{r.choice('.. ?')}") for t in range(900)]
    rows += [(c, t, "user", "Hi.") for c in range(40) for t in range(5)]
    whole = sorted(map(tuple, R.repair(spread(spark, rows), 1 << 20).collect()), key=str)
    assert sorted(map(tuple, R.repair(spread(spark, rows), 16).collect()), key=str) == whole


def test_auction_finds_distances():
    def table_cost(codes):
        cost = [0, 4, 2, 0]
        for code in reversed(codes):
            initial, fault = code & 3, code >> 2
            more = int(fault == R.CUT)
            b = []
            for s in range(4):
                ways = [3 + cost[s]]
                if fault not in (R.BLANK, R.DUPLICATE):
                    ways.append(2 + more + cost[R.TURN[s][1]])
                    if (s, initial) in R.KEEP:
                        ways.append(more + cost[R.KEEP[s, initial]])
                b.append(min(ways))
            cost = [min(b[s], 2 + b[R.TURN[s][1]], 4 + b[R.TURN[R.TURN[s][1]][1]]) for s in range(4)]
        return cost[0]

    r = random.Random(8)
    for n in (0, 1, 2, 5, 40, 300):
        for _ in range(20):
            codes = bytes(r.randrange(16) for _ in range(n))
            cost, letters = R.solve(codes)
            assert cost == table_cost(codes)
            assert sum(x != "I" for x in letters) == n


def test_empty(spark):
    assert R.repair(spark.createDataFrame([], SCHEMA)).count() == 0
