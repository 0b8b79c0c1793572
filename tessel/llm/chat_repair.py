"""Conversation structure repair: cheapest edits by the auction shortest-path algorithm.

Rows of a conversation are layers of a lattice with four states (nothing yet; after system;
after user; after assistant); an edit is an arc: Delete and Keep and Rerole go to the next layer,
Insert stays in its layer. Costs are integers. The auction keeps a price per node and one path
from the origin: at the path's end, if the node's price is below the best ``cost + price of the head``,
the price is raised and the path contracts by a node; else the path extends to that head.
Prices start at what the remaining rows cost at least and stay feasible, so on
arrival the origin's price is the distance and every shortest path runs over tight arcs (price = cost +
price of the head). Among tight arcs that lead on to the end the trace takes the least letter (D, I, K, R).

A conversation may hold a third of all rows. Rows are numbered by one range-partitioned sort and cut by a
grid of ``SEGMENT`` numbers, so a task never holds more than a segment's rows. A conversation within one cell
is solved at once. For the others, auctions give each segment the distances between its entry and
exit states; a backward stream over a conversation's segments (four integers are all it holds) turns them
into prices at every segment's end; segments are then traced from each entry state side by side, and a forward
stream picks the traces that join. The digest of a conversation's text is one hash over all its rows in order, so
its rows stream through one task, a batch at a time.

Ties and nulls: nulls in ``conv_id``, ``turn``, ``role`` and ``text`` count as one blank, but a null turn sorts first
and has no part in ``gaps``; rows of one turn are ordered by role, then text (equal rows are
interchangeable). A null ``conv_id`` is a conversation of its own. Rows of an empty role, or of a role that begins with
none of s, u, a, cannot be kept as they are. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import stored

SEGMENT = 128
#: Segments remembered by a worker.
SEEN = 20_000
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = (START, ASSISTANT)
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A row's code: role initial (0 s, 1 u, 2 a, 3 other) + 4 * fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: The role that user/assistant edits give after a state, and the state after it.
TURN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: (state, role initial) -> state of a kept row.
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
FAR = 1 << 40


class Lattice:
    """Nodes ``4 * layer + state`` of a segment and one end node, arcs as (letter, cost, head)."""

    def __init__(self, codes: bytes, last: bool, ends: tuple[int, ...]):
        """``ends``: price of each state after the last row (``FAR`` and above: no way on)."""
        n = self.rows = len(codes)
        self.end = 4 * (n + 1)
        self.arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(self.end)]
        for i, code in enumerate(codes):
            initial, fault = code & 3, code >> 2
            for s in range(4):
                node, out = 4 * i + s, self.arcs[4 * i + s]
                out.append(("D", DELETE, 4 * (i + 1) + s))
                out.append(("I", INSERT, 4 * i + TURN[s][1]))
                if fault not in (BLANK, DUPLICATE):
                    more = TRUNCATED if fault == CUT else 0
                    if (s, initial) in KEEP:
                        out.append(("K", more, 4 * (i + 1) + KEEP[s, initial]))
                    out.append(("R", REROLE + more, 4 * (i + 1) + TURN[s][1]))
        for s in range(4):
            if ends[s] < FAR:
                self.arcs[4 * n + s].append(("", ends[s], self.end))
            if last:  # elsewhere the next segment's first layer has these arcs
                self.arcs[4 * n + s].append(("I", INSERT, 4 * n + TURN[s][1]))
        # nodes with a way to the end; arcs into others go
        ok = self.backward(lambda node, cost, head: True)
        self.arcs = [[a for a in out if ok[a[2]]] for out in self.arcs]
        self.ok = ok
        # what the rows ahead cost at least: feasible prices to start from
        least = min(e for e in ends if e < FAR)
        self.price = [least] * (self.end + 1)
        for i in range(n - 1, -1, -1):
            fault = codes[i] >> 2
            least += DELETE if fault in (BLANK, DUPLICATE) else TRUNCATED if fault == CUT else 0
            self.price[4 * i:4 * i + 4] = [least] * 4
        self.price[self.end] = 0

    def backward(self, use) -> list[bool]:
        """Nodes from which the end is reached over arcs that ``use`` admits."""
        ok = [False] * self.end + [True]
        for layer in range(self.rows, -1, -1):
            for _ in range(3):  # inserts stay within the layer: user, assistant, user
                for node in range(4 * layer, 4 * layer + 4):
                    ok[node] = ok[node] or any(ok[h] and use(node, c, h) for _, c, h in self.arcs[node])
        return ok

    def distance(self, origin: int) -> int:
        """Forward auction from ``origin``; prices stay for the next origin."""
        if not self.ok[origin]:
            return FAR
        price, arcs, path = self.price, self.arcs, [origin]
        while path[-1] != self.end:
            node = path[-1]
            best, head = FAR, -1
            for _, cost, h in arcs[node]:
                if cost + price[h] < best:
                    best, head = cost + price[h], h
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        return price[origin]

    def trace(self, origin: int) -> tuple[str, int]:
        """The least letters of a shortest path from ``origin`` (after ``distance``), and the state it ends in."""
        price = self.price
        tight = self.backward(lambda node, cost, head: price[node] == cost + price[head])
        letters, node, state = [], origin, origin
        while node != self.end:
            state = node & 3
            letter, _, node = min((x, c, h) for x, c, h in self.arcs[node] if tight[h] and price[node] == c + price[h])
            letters.append(letter)
        return "".join(letters), state


def solve(codes: bytes) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    g = Lattice(codes, True, tuple(0 if s in ACCEPT else FAR for s in range(4)))
    return g.distance(START), g.trace(START)[0]


def transfer(codes: bytes) -> list[int]:
    """Distances from entry state s to exit state t of a segment, at ``4 * s + t``."""
    out = [FAR] * 16
    for t in range(4):
        g = Lattice(codes, False, tuple(0 if s == t else FAR for s in range(4)))
        for s in range(4):
            out[4 * s + t] = g.distance(s)
    return out


def traces(codes: bytes, last: bool, ends: tuple[int, ...]) -> list[tuple[str, int]]:
    """For each entry state: edits and exit state, given the prices after the segment."""
    g = Lattice(codes, last, ends)
    out = []
    for s in range(4):
        out.append(g.trace(s) if g.distance(s) < FAR else ("", s))
    return out


def follow(codes: bytes, state: int, audit: str) -> list[tuple[str, list[str], list[str]]]:
    """Per row: the role it gets (``=`` its own, empty: deleted) and the roles inserted before and after it."""
    out, before = [], []
    for x in audit:
        role, after = TURN[state]
        if x == "I":
            before.append(role)
            state = after
            continue
        code = codes[len(out)]
        out.append(("" if x == "D" else role if x == "R" else "=", before, []))
        before = []
        if x != "D":
            state = after if x == "R" else KEEP[state, code & 3]
    if before:
        out[-1] = (out[-1][0], out[-1][1], before)
    return out


def illegal_pairs(codes: bytes) -> int:
    """Adjacent role initials other than su, ua, au."""
    return sum((a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:]))


class Remembered:
    """A function's results for the segments a worker saw lately; few different ones are frequent."""

    def __init__(self, fn):
        self.fn, self.seen = fn, {}

    def __call__(self, *key):
        if key not in self.seen:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            self.seen[key] = self.fn(*key)
        return self.seen[key]


BLANKS = "[^\\x20\\x09-\\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: ``conv_id, turn, role, text`` (nulls of role and text: one blank)."""
    c, t = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    key = F.concat(F.coalesce(c.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(t.cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    d = conversations.select(c.alias("conv_id"), t.alias("turn"), kind.alias("kind"), role.alias("role"), text.alias("text")).where("kind <> 0")
    d = d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                 F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                 F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return d.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``seq``, their number in the order of conversation, turn, role and text."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    # equal rows in different ranges too: the last key deals them (they are interchangeable)
    s = rows.withColumn("tie", F.monotonically_increasing_id()).sort(*keys, "tie").drop("tie")
    s = stored(s.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "turns")
    before = s.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition of the sort
    return s.join(F.broadcast(before.select("part", "before")), "part").withColumn("seq", F.col("before") + F.col("at")).drop("part", "at", "before")


def coded(rows: DataFrame) -> DataFrame:
    """``conv_id, seq, code`` of every row."""
    ends = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    initial = F.substring("role", 1, 1)
    r = rows.select("conv_id", "seq", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")).alias("said"),
                    F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
                    F.when(ends == "", BLANK).when(ends.isin(".", "!", "?"), SOUND).otherwise(CUT).alias("fault"))
    r = stored(r, "codes")
    first = r.groupBy("conv_id", "said").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    r = r.join(first, "seq", "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    return r.select("conv_id", "seq", (F.col("initial") + 4 * fault).alias("code"))


def codes_of(column: pa.Array) -> list[bytes]:
    return [bytes(x) for x in column.to_pylist()]


def repairs(codes: DataFrame, segment: int) -> DataFrame:
    """Solved segments: ``conv_id, cell, first`` (number of its first row), ``codes, state`` (entry), ``audit, cost`` (of the
    whole conversation, at its first segment, else 0), ``illegal`` (with the pair that joins it to the segment before)."""
    cell = F.floor(F.col("seq") / segment).cast("bigint")
    seg = codes.groupBy("conv_id", cell.alias("cell")).agg(F.sort_array(F.collect_list(F.struct("seq", "code"))).alias("rows"))
    seg = stored(seg.select("conv_id", "cell", F.col("rows.seq")[0].alias("first"), F.col("rows.code").alias("codes")), "segments")
    wide = seg.groupBy("conv_id").agg(F.min("cell").alias("from"), F.max("cell").alias("to"))
    same = F.col("w.conv_id").eqNullSafe(F.col("s.conv_id"))
    # the merge join takes apart a conversation with many segments (adaptive skew join)
    marked = stored(seg.alias("s").join(wide.where(F.col("from") < F.col("to")).alias("w"), same, "left").select("s.*", "w.from", "w.to"), "marked")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        go = Remembered(solve)
        for b in batches:
            codes = codes_of(b.column(3))
            got = [go(x) for x in codes]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array([START] * len(codes), pa.int32()), pa.array([a for _, a in got], pa.string()),
                 pa.array([c for c, _ in got], pa.int64()), pa.array([illegal_pairs(x) for x in codes], pa.int64())], names=SOLVED_NAMES)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        go = Remembered(transfer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([go(x) for x in codes_of(b.column(3))], pa.list_(pa.int64()))],
                                             names=[*b.schema.names, "far"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = None
        for b in batches:
            out, costs = [], []
            for cell, to, far in zip(b.column(1).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist()):
                if cell == to:
                    # the last one may go on inserting at its end
                    ends = [0, 2 * INSERT, INSERT, 0]
                out.append(ends)
                ends = [min(FAR, min(far[4 * s + t] + ends[t] for t in range(4))) for s in range(4)]
                costs.append(ends[START])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(out, pa.list_(pa.int64())), pa.array(costs, pa.int64())],
                                             names=[*b.schema.names[:6], "ends", "ahead"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        go = Remembered(traces)
        for b in batches:
            got = []
            for cell, codes, to, ends in zip(b.column(1).to_pylist(), codes_of(b.column(3)), b.column(5).to_pylist(), b.column(6).to_pylist()):
                last = cell == to
                low = min(ends)
                ends = tuple(0 if s in ACCEPT else FAR for s in range(4)) if last else tuple(e - low if e < FAR else FAR for e in ends)
                got.append(go(codes, last, ends))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in (0, 1, 2, 3, 4, 7)), pa.array([[a for a, _ in x] for x in got], pa.list_(pa.string())),
                 pa.array([[e for _, e in x] for x in got], pa.list_(pa.int32()))],
                names=["conv_id", "cell", "first", "codes", "from", "ahead", "audits", "exits"])

    def forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = START, b""
        for b in batches:
            rows = []
            for cell, codes, start, ahead, audits, exits in zip(b.column(1).to_pylist(), codes_of(b.column(3)), *(b.column(i).to_pylist() for i in range(4, 8))):
                if cell == start:
                    state, held = START, b""
                rows.append((state, audits[state], ahead if cell == start else 0, illegal_pairs(held + codes)))
                state, held = exits[state], codes[-1:]
            s, a, c, i = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(s, pa.int32()), pa.array(a, pa.string()),
                                              pa.array(c, pa.int64()), pa.array(i, pa.int64())], names=SOLVED_NAMES)

    base = "conv_id long, cell long, first long, codes array<int>"
    one = marked.where("from IS NULL").select("conv_id", "cell", "first", "codes").mapInArrow(whole, SOLVED)
    many = marked.where("from IS NOT NULL")
    far = stored(many.mapInArrow(distances, f"{base}, from long, to long, far array<long>"), "transfers")
    far = far.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("cell"))
    ends = stored(far.mapInArrow(back, f"{base}, from long, to long, ends array<long>, ahead long"), "ends")
    ways = ends.repartition("conv_id", "cell").mapInArrow(each, f"{base}, from long, ahead long, audits array<string>, exits array<int>")
    ways = stored(ways, "ways").repartition("conv_id").sortWithinPartitions("conv_id", "cell")
    return stored(one.unionAll(ways.mapInArrow(forth, SOLVED)), "solved")


SOLVED_NAMES = ["conv_id", "cell", "first", "codes", "state", "audit", "cost", "illegal"]
SOLVED = "conv_id long, cell long, first long, codes array<int>, state int, audit string, cost long, illegal long"


def edits(solved: DataFrame) -> DataFrame:
    """``seq, role, before, after`` of every row, and how the repaired conversation reads at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for first, codes, state, audit in zip(b.column(0).to_pylist(), codes_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                out += [(first + i, *x) for i, x in enumerate(follow(codes, state, audit))]
            if out:
                seq, role, before, after = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(role), pa.array(before, pa.list_(pa.string())), pa.array(after, pa.list_(pa.string()))],
                                                 names=["seq", "new_role", "before", "after"])

    return solved.select("first", "codes", "state", "audit").mapInArrow(run, "seq long, new_role string, before array<string>, after array<string>")


def repaired_rows(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, seq, place, role, text`` in the order of (seq, place)."""
    r = rows.join(edits(solved), "seq")

    def empty(names):
        return F.transform(names, lambda x: F.struct(x.alias("role"), F.lit("").alias("text")))

    own = F.struct(F.when(F.col("new_role") == "=", F.col("role")).otherwise(F.col("new_role")).alias("role"), F.col("text").alias("text"))
    kept = F.when(F.col("new_role") == "", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(own))
    r = r.select("conv_id", "seq", F.posexplode(F.concat(empty("before"), kept, empty("after"))).alias("place", "x"))
    return r.select("conv_id", "seq", "place", "x.role", "x.text")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over newline-joined ``role:text``. Rows stream in order; a task holds one hash state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for conv, line in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(line)
                else:
                    state.update(b"\n")
                    state.update(line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([x for _, x in done])], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    r = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "place")
    return r.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per ``conv_id`` of the table: faults of its rows after damage, cost and letters of the cheapest
    edits, and the digest of the repaired text."""
    rows = ordered(damaged(conversations))
    solved = repairs(coded(rows), segment)

    def faults(kind: int):
        return F.size(F.filter("codes", lambda x: F.shiftright(x, 2) == kind)).cast("bigint")

    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell", "audit"))), lambda x: x["audit"]), "")
    by_conv = solved.groupBy("conv_id").agg(
        *(F.sum(faults(k)).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))),
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    turns = rows.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    out = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().alias("c")
    for i, part in enumerate((turns, by_conv, digests(repaired_rows(rows, solved)))):
        part = part.withColumnRenamed("conv_id", f"conv_{i}")
        out = out.join(part, F.col("c.conv_id").eqNullSafe(F.col(f"conv_{i}")), "left")
    zero = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("c.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
