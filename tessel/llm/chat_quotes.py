"""Chat formatting by quotation linking, in DataFrame functions only.

A line that begins with one or more ``>`` is quoted at that level. Lines are
normalised (quote marks off, white space collapsed, lower case). Consecutive lines
of one level without a blank line between them form a passage. Passages and
single lines are hashed. A passage or line of level n is joined to the latest
earlier message of its conversation that holds the same passage or line at a level below n (level 1:
as its own, level 0 text). The lowest level with such a link decides: the message with the most matched
characters of that level is the parent (ties: the later one). A message without any link replies to the one before it.

Reply order: a linked message, and what follows it without a link of its own, stands right
after the message it quotes (several such by turn), before the message that followed there. ``position`` is a
message's place in that order, from 0: the preorder of the tree of parents, found as the ranks of its Euler tour by pointer jumping;
sorting by (conv_id, position) gives the conversations, and a message always comes after its parent.
``text`` has no quoted lines and no "On ... wrote:" line before them.

Distribution: every "latest earlier turn" is found within ranges of ``RANGE``
turns, with the last turn of earlier ranges carried over, so that a conversation that
holds a third of all rows is many small groups. The tour of a conversation of n messages takes about log2(2n)
joins of one row per element by unique pointers, however long a chain of replies is; conversations without links need none.

Defined results: null text stays null; an empty text stays empty; a text without quoted lines
stays as it is. Rows with a null conv_id or turn keep their cleaned text and have no parent or position. Rows
of the same conv_id and turn are one turn for links, and all of them are returned. Extra columns are
ignored. Quoted lines without an original are dropped from the text like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import count_rows, stored

RANGE = 512
MARK = r"^[ \t]*>"
PREFIX = r"^((?:[ \t]*>)+)"
WROTE = r"^[ \t]*On .* wrote:[ \t]*$"


def latest_before(queries: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, out: str) -> DataFrame:
    """``queries`` (keys + at) with ``out``: the largest ``mark`` of ``marks`` (keys + mark)
    strictly below ``at`` under the same keys, or null."""
    q = queries.select(*keys, F.col(at).alias("__t"), F.lit(None).cast("bigint").alias("__m")).distinct()
    m = marks.select(*keys, F.col(mark).alias("__t"), F.col(mark).alias("__m")).distinct()
    both = q.unionByName(m).withColumn("__r", F.floor(F.col("__t") / RANGE))
    inside = Window.partitionBy(*keys, "__r").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("__near", F.max("__m").over(inside)).where("__m IS NULL")
    ranges = both.groupBy(*keys, "__r").agg(F.max("__m").alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranges.withColumn("__carry", F.max("__last").over(before)).drop("__last")
    found = near.join(carry, [*keys, "__r"]).select(*keys, F.col("__t").alias(at), F.coalesce("__near", "__carry").alias(out))
    return queries.join(found, [*keys, at])


def clean_text() -> Column:
    """The text without quoted lines and the line that introduces them."""
    lines = F.split("text", "\n", -1)
    quoted = lambda x: x.rlike(MARK)
    # a line "On ... wrote:" goes if the next line is quoted
    kept = F.filter(lines, lambda x, i: ~quoted(x) & ~(x.rlike(WROTE) & F.coalesce(quoted(F.get(lines, i + 1)), F.lit(False))))
    return F.when(F.col("text").rlike("(?m)" + MARK), F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")).otherwise(F.col("text"))


def units(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, unit, size``: hashed passages and lines of messages."""
    rows = messages.select("conv_id", "turn", F.xxhash64("role", "text").alias("row"), "text").dropDuplicates(["conv_id", "turn", "row"])
    line = rows.select("conv_id", "turn", "row", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    mark = F.regexp_extract("line", PREFIX, 1)
    line = line.withColumn("mark", mark)
    line = line.select("conv_id", "turn", "row", "at", F.length(F.regexp_replace("mark", "[^>]", "")).alias("level"),
                       F.lower(F.trim(F.regexp_replace(F.expr("substring(line, length(mark) + 1)"), r"[ \t\r]+", " "))).alias("norm"))
    w = Window.partitionBy("conv_id", "turn", "row").orderBy("at")
    new = (F.lag("level").over(w) != F.col("level")) | (F.lag("norm").over(w) == "")
    line = line.withColumn("new", F.coalesce(new, F.lit(False)).cast("int"))
    line = line.withColumn("passage", F.sum("new").over(w)).where("norm != ''")
    passage = (line.groupBy("conv_id", "turn", "row", "passage", "level").agg(F.array_sort(F.collect_list(F.struct("at", "norm"))).alias("parts"))
               .select("conv_id", "turn", "level", F.array_join("parts.norm", " ").alias("norm")))
    all_ = passage.unionByName(line.select("conv_id", "turn", "level", "norm"))
    return all_.select("conv_id", "turn", "level", F.md5("norm").alias("unit"), F.length("norm").alias("size")).distinct()


def parents(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, linked``: the quoted turn of each replying turn."""
    asked = messages.where(F.col("text").rlike("(?m)" + MARK)).select("conv_id").distinct()
    u = stored(units(messages.join(asked, "conv_id", "left_semi")), "units")
    quoted = u.where("level > 0")
    deepest = quoted.groupBy("conv_id", "unit").agg(F.max("level").alias("deepest"))
    own = u.join(deepest, ["conv_id", "unit"]).where("level < deepest")
    # the levels below n are one span for each set bit of n: spans of 2^bit levels, numbered from 0
    own = own.withColumn("bit", F.explode(F.expr("sequence(0, length(bin(deepest)) - 1)"))).withColumn("span", F.expr("shiftright(level, bit)"))
    asks = quoted.withColumn("bit", F.explode(F.expr("filter(sequence(0, length(bin(level)) - 1), b -> shiftright(level, b) % 2 = 1)")))
    asks = asks.withColumn("span", F.expr("shiftright(level, bit) - 1"))
    hits = latest_before(asks, own, ["conv_id", "unit", "bit", "span"], "turn", "turn", "original").where("original IS NOT NULL")
    hits = hits.groupBy("conv_id", "turn", "level", "unit", "size").agg(F.max("original").alias("original"))
    best = (hits.groupBy("conv_id", "turn", "level", "original").agg(F.sum("size").alias("size"))
            .groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "size", "original")).alias("best")))
    return best.select("conv_id", "turn", F.col("best.original").alias("linked"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, parent_turn, quotes, position`` per message, in reply order."""
    messages = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                    F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    links = stored(parents(known), "links")
    turns = stored(known.select("conv_id", "turn").distinct(), "turns")
    turns = in_turn_order(turns).join(links, ["conv_id", "turn"], "left")
    turns = stored(turns.withColumn("parent_turn", F.coalesce("linked", "before")), "turns")
    info = turns
    if count_rows(links):
        threaded = stored(turns.join(links.select("conv_id").distinct(), "conv_id", "left_semi"), "threaded")
        place = stored(in_reply_order(threaded), "places").withColumnRenamed("position", "place")
        info = turns.join(place, ["conv_id", "turn"], "left").withColumn("position", F.coalesce("place", "position"))
    info = info.select("conv_id", "turn", "parent_turn", F.col("linked").isNotNull().alias("quotes"), "position")
    out = messages.join(info, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", clean_text().alias("text"), "parent_turn", F.coalesce("quotes", F.lit(False)).alias("quotes"), "position")
    return out.orderBy("conv_id", "position", "role", "text")


def in_turn_order(turns: DataFrame) -> DataFrame:
    """``conv_id, turn`` with the turn ``before`` and the ``position`` by turn, both within ranges and carried over from earlier ones."""
    t = turns.select("conv_id", "turn").withColumn("range", F.floor(F.col("turn") / RANGE))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = t.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    ranges = ranges.select("conv_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"), F.max("last").over(earlier).alias("last"))
    inside = Window.partitionBy("conv_id", "range").orderBy("turn")
    t = t.withColumn("near", F.lag("turn").over(inside)).withColumn("inside", F.row_number().over(inside) - 1).join(ranges, ["conv_id", "range"])
    return t.select("conv_id", "turn", F.coalesce("near", "last").alias("before"), (F.col("carried") + F.col("inside")).alias("position"))


def in_reply_order(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, position`` for ``conv_id, turn, linked, before``: ranks of the Euler tour. Element 2t enters message t, 2t + 1
    leaves it; the replies that quote a message come first, by turn, then the message that follows it."""
    quoting = turns.where("linked IS NOT NULL").select("conv_id", F.col("linked").alias("parent"), "turn")
    follows = turns.where("linked IS NULL AND before IS NOT NULL").select("conv_id", F.col("before").alias("parent"), F.col("turn").alias("follower"))
    first = quoting.groupBy("conv_id", "parent").agg(F.min("turn").alias("quoted_by"))
    t = (turns.select("conv_id", "turn", F.coalesce("linked", "before").alias("parent"), F.col("linked").isNotNull().alias("quotes"))
         .join(first.withColumnRenamed("parent", "turn"), ["conv_id", "turn"], "left")
         .join(follows.withColumnRenamed("parent", "turn"), ["conv_id", "turn"], "left"))
    # the next reply to the same message: the largest negated turn below one's own
    back = quoting.select("conv_id", "parent", (-F.col("turn")).alias("back"))
    later = latest_before(back, back, ["conv_id", "parent"], "back", "back", "next").select(
        "conv_id", (-F.col("back")).alias("turn"), (-F.col("next")).alias("next"))
    up = follows.withColumnRenamed("follower", "parents_follower")
    t = t.join(later, ["conv_id", "turn"], "left").join(up, ["conv_id", "parent"], "left")
    after = F.coalesce("next", F.when(F.col("quotes"), F.col("parents_follower")))
    enter = F.coalesce(2 * F.coalesce("quoted_by", "follower"), 2 * F.col("turn") + 1)
    leave = F.coalesce(2 * after, 2 * F.col("parent") + 1)
    both = F.array(F.struct((2 * F.col("turn")).alias("e"), enter.alias("to"), F.lit(1).cast("bigint").alias("n")),
                   F.struct((2 * F.col("turn") + 1).alias("e"), leave.alias("to"), F.lit(0).cast("bigint").alias("n")))
    tour = stored(t.select("conv_id", F.explode(both).alias("x")).select("conv_id", "x.*"), "tour")
    while count_rows(tour.where("to IS NOT NULL")):  # n: messages entered from an element up to where its pointer leads
        ahead = tour.select("conv_id", F.col("e").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        tour = stored(tour.join(ahead, ["conv_id", "to"], "left").select("conv_id", "e", F.col("to2").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "tour")
    entered = tour.where("pmod(e, 2) = 0").select("conv_id", F.expr("e div 2").alias("turn"), "n")
    total = entered.groupBy("conv_id").agg(F.max("n").alias("all"))
    return entered.join(total, "conv_id").select("conv_id", "turn", (F.col("all") - F.col("n")).alias("position"))


#: The same rows in DuckDB, with the order by paths of (quoted turn, replying turn).
SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text FROM conversations),
known AS (SELECT * FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
raw AS (SELECT DISTINCT conv_id, turn, md5(coalesce(role, '') || '|' || coalesce(text, '')) AS r, text FROM known
        WHERE conv_id IN (SELECT conv_id FROM known WHERE regexp_matches(text, '(?m)^[ \t]*>'))),
line AS (SELECT conv_id, turn, r, unnest(range(len(s))) AS pos, unnest(s) AS line FROM (SELECT *, string_split(text, chr(10)) AS s FROM raw)),
lev AS (SELECT *, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS mark FROM line),
nrm AS (SELECT conv_id, turn, r, pos, length(regexp_replace(mark, '[^>]', '', 'g')) AS level,
               lower(trim(regexp_replace(substr(line, length(mark) + 1), '[ \t\r]+', ' ', 'g'))) AS norm FROM lev),
brk AS (SELECT *, CASE WHEN lag(level) OVER w <> level OR lag(norm) OVER w = '' THEN 1 ELSE 0 END AS nw FROM nrm
        WINDOW w AS (PARTITION BY conv_id, turn, r ORDER BY pos)),
pas AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id, turn, r ORDER BY pos) AS passage FROM brk),
u AS (SELECT DISTINCT conv_id, turn, level, md5(norm) AS unit, length(norm) AS size FROM (
        SELECT conv_id, turn, level, string_agg(norm, ' ' ORDER BY pos) AS norm FROM pas WHERE norm <> '' GROUP BY conv_id, turn, r, passage, level
        UNION ALL SELECT conv_id, turn, level, norm FROM pas WHERE norm <> '')),
hit AS (SELECT q.conv_id, q.turn, q.level, q.unit, q.size, max(o.turn) AS original FROM u q JOIN u o
        ON o.conv_id = q.conv_id AND o.unit = q.unit AND o.level < q.level AND o.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
sums AS (SELECT conv_id, turn, level, original, sum(size) AS size FROM hit GROUP BY ALL),
link AS (SELECT conv_id, turn, original AS linked FROM sums QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, original DESC) = 1),
t0 AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM known)),
t1 AS (SELECT t0.*, linked, coalesce(linked, before) AS parent_turn, CASE WHEN linked IS NOT NULL OR before IS NULL THEN turn END AS is_head
       FROM t0 LEFT JOIN link USING (conv_id, turn)),
t AS (SELECT *, max(is_head) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM t1),
path(conv_id, head, path) AS (
  SELECT conv_id, turn, [turn] FROM t WHERE is_head IS NOT NULL AND linked IS NULL
  UNION ALL
  SELECT x.conv_id, x.turn, list_concat(p.path, [x.linked, x.turn])
  FROM t x JOIN t l ON l.conv_id = x.conv_id AND l.turn = x.linked JOIN path p ON p.conv_id = l.conv_id AND p.head = l.head WHERE x.linked IS NOT NULL)
SELECT m.conv_id, m.turn, m.role,
  CASE WHEN regexp_matches(m.text, '(?m)^[ \t]*>') THEN regexp_replace(array_to_string(list_transform(list_filter(
       list_zip(string_split(m.text, chr(10)), list_concat(string_split(m.text, chr(10))[2:], [''])),
       lambda x: NOT regexp_matches(x[1], '^[ \t]*>') AND NOT (regexp_matches(x[1], '^[ \t]*On .* wrote:[ \t]*$') AND regexp_matches(coalesce(x[2], ''), '^[ \t]*>'))),
       lambda x: x[1]), chr(10)), '^\s+|\s+$', '', 'g') ELSE m.text END AS text,
  t.parent_turn, t.linked IS NOT NULL AS quotes, CASE WHEN t.turn IS NOT NULL THEN dense_rank() OVER (PARTITION BY m.conv_id, t.turn IS NULL ORDER BY list_concat(path.path, [t.turn])) - 1 END AS position
FROM m LEFT JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn LEFT JOIN path ON path.conv_id = t.conv_id AND path.head = t.head
"""
