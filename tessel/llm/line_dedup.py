"""Line dedup by pairwise alignment (patience diff).

1. One pass over whole texts writes, per document, the hash and the number of words of
   every line (white space at the ends and repeated inside does not count; blank lines are
   aligned with nothing).
2. Overlapping documents are found through shared runs: from each line and to each line the
   shortest run of consecutive lines that reaches ``block_words`` words, short lines joined like long ones.
   The earliest holder of each run meets every later
   holder, so a run that n documents hold gives n - 1 pairs. Any block that could go contains
   such runs, and every line of it lies in one.
3. A pair is aligned by patience diff over the runs the two share, in their order in either document: runs that occur
   once in both and keep their order (longest rising sequence) are anchors, the gaps between anchors
   are aligned in the same way, and equal runs next to an anchor join it. What a round leaves of the later
   document (passages in another order, or more often) is aligned with the whole earlier one again; a round
   without an anchor aligns the rarest run left.
4. Aligned runs that touch or overlap are blocks, and blocks are deleted from the later document. The rounds end when no shared
   run is left, so a line goes exactly if it lies in a run of that many words that an earlier document holds too.

Earlier and later: by doc_id, then by the text's hash; null ids come last. A
document that is both copied and copying loses lines but still serves others as
it was, so results do not depend on any order of work.

Distribution: only run hashes and their places move until the end. A pair carries the runs it shares, not its documents, so
a long early document costs nothing for what its later holders do not share. Texts
move once, when the deletions are joined to them.

Defined results: null text stays null (no lines), an empty text stays empty; rows equal in
doc_id and text are one document (all its copies lose the same lines); a document
without deletions keeps its text byte for byte; if all lines go, the text is
empty. Extra columns pass through; an appended column whose name is taken gets underscores behind it.
"""

from __future__ import annotations

import bisect
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import arrow_slices, byte_texts, free, stored

#: A line of fewer words counts none towards a block; with 1 every line counts.
LINE_WORDS, BLOCK_WORDS = 1, 25
#: Null ids sort after all others.
LAST = 2 ** 63 - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_numbers(raw: bytes) -> tuple[list[int], list[int]]:
    """Hash and words of each line; a blank line has hash 0 and no words."""
    hashes, words = [], []
    for line in raw.split(b"\n"):
        w = line.split()
        hashes.append(signed(xxhash.xxh3_64_intdigest(b" ".join(w)) | 1) if w else 0)
        words.append(len(w))
    return hashes, words


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (first parts ascending) whose second parts ascend."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        before[n] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(j)
            at.append(n)
        else:
            tails[k], at[k] = j, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned line positions of two documents (blank lines only inside runs)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {x: i for i, x in enumerate(b[b0:b1], b0) if x and cb[x] == 1 and ca.get(x) == 1}
        anchors = rising([(i, once[x]) for i, x in enumerate(a[a0:a1], a0) if x in once])
        if anchors:
            i, j = a0, b0
            for x, y in anchors:
                todo.append((i, x, j, y))
                out.append((x, y))
                i, j = x + 1, y + 1
            todo.append((i, a1, j, b1))
    return sorted(out)


def runs(hashes: list[int], words: list[int], block_words: int) -> list[tuple[int, int]]:
    """Shortest line ranges (start, end) of at least ``block_words`` words from each start and to each end, and
    from a line over blank ones to the next. Every line of a longer run lies in one of them inside that run."""
    at = [i for i, x in enumerate(hashes) if x]
    w = [words[i] for i in at]
    out = set()
    total = s = 0
    for e, n in enumerate(w):
        total += n
        while total - w[s] >= block_words:
            total -= w[s]
            s += 1
        if total >= block_words:
            out.add((at[s], at[e] + 1))
    total, e = 0, len(at) - 1
    for s in range(len(at) - 1, -1, -1):
        total += w[s]
        while total - w[e] >= block_words:
            total -= w[e]
            e -= 1
        if total >= block_words:
            out.add((at[s], at[e] + 1))
    out.update((i, j + 1) for i, j in zip(at, at[1:]) if j > i + 1 and words[i] + words[j] >= block_words)
    return sorted(out)


def placed_runs(hashes: list[int], words: list[int], block_words: int) -> list[tuple[int, int, int]]:
    """(hash, start, end) of a document's ``runs``, by place."""
    raw = memoryview(array("q", hashes).tobytes())
    return [(signed(xxhash.xxh3_64_intdigest(raw[8 * s:8 * e]) | 1), s, e) for s, e in runs(hashes, words, block_words)]


def align(a: list[int], b: list[int]) -> list[int]:
    """Places in ``b`` that rounds of patience alignment with ``a`` match; both are shared runs in their order."""
    left, out = list(range(len(b))), []
    held = Counter(a)
    while left:
        got = [j for _, j in patience(a, [b[i] for i in left])]
        if not got:
            count = Counter(b[i] for i in left)
            rarest = min(count, key=lambda x: (held[x] * count[x], x))
            got = [j for j, i in enumerate(left) if b[i] == rarest] if held[rarest] else []
        if not got:
            return sorted(out)
        out += [left[j] for j in got]
        gone = set(got)
        left = [i for j, i in enumerate(left) if j not in gone]
    return sorted(out)


def aligned_blocks(shared: list[tuple[int, list[int], list[int], list[int]]]) -> list[tuple[int, int]]:
    """Line ranges to delete from the later document of a pair, given its shared runs as (hash, starts in the
    earlier one, starts and ends in the later one)."""
    a = [h for _, h in sorted((s, h) for h, starts, _, _ in shared for s in starts)]
    b = sorted((s, e, h) for h, _, starts, ends in shared for s, e in zip(starts, ends))
    return joined([b[i][:2] for i in align(a, [h for _, _, h in b])])


def blocks(a: list[int], b: list[int], words_b: list[int], block_words: int) -> list[tuple[int, int]]:
    """Line ranges of ``b`` (start, end) that go if ``a`` is earlier. ``words_b`` counts 0 for a line too short to count."""
    words, there, here, start = dict(zip(b, words_b)), {}, {}, 0
    for end in [i for i, x in enumerate(a) if x not in words] + [len(a)]:
        part = a[start:end]
        for h, s, _ in placed_runs(part, [words[x] for x in part], block_words):
            there.setdefault(h, []).append(start + s)
        start = end + 1
    for h, s, e in placed_runs(b, words_b, block_words):
        if h in there:
            here.setdefault(h, ([], []))[0].append(s)
            here[h][1].append(e)
    return aligned_blocks([(h, there[h], *x) for h, x in here.items()])


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def overlaps(held: DataFrame) -> DataFrame:
    """``a, b, run, there, starts, ends``: runs of b whose earliest holder is a, and where they stand in either."""
    # the earliest holder of each run, combined before the shuffle
    first = held.groupBy("run").agg(F.min(F.struct("key", "starts")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a table of its own: adaptive execution may then split a hot run
    first = stored(first.select("run", F.col("first.key").alias("a"), F.col("first.starts").alias("there")), "first")
    return held.join(first, "run").where(F.col("key") != F.col("a")).select("a", F.col("key").alias("b"), "run", "there", "starts", "ends")


def key_columns() -> list:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("h")]


def deletions(docs: DataFrame, line_words: int = LINE_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``d, h`` (a document's key) and ``cut``: its line ranges (start, end) to delete."""
    src = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").select(*key_columns(), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for b in arrow_slices(batches):
            out: list[tuple] = []
            for d, h, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2))):
                hashes, words = line_numbers(raw)
                places: dict[int, tuple[list, list]] = {}
                for run, s, e in placed_runs(hashes, [n if n >= line_words else 0 for n in words], block_words):
                    at = places.setdefault(run, ([], []))
                    at[0].append(s)
                    at[1].append(e)
                out += [(d, h, run, *at) for run, at in places.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 3, ints, ints))],
                                                 names=["d", "h", "run", "starts", "ends"])

    held = src.mapInArrow(read, "d long, h long, run long, starts array<int>, ends array<int>")
    held = stored(held.select(F.struct("d", "h").alias("key"), "run", "starts", "ends"), "runs")
    # at most a document's lines in a pair; rows of equal documents come together
    pairs = overlaps(held).groupBy("a", "b").agg(F.collect_set(F.struct("run", "there", "starts", "ends")).alias("shared"))

    def cut_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few rows at a time as Python lists: they are several times larger
                b = batch.slice(at, 64)
                out: list[tuple] = []
                for d, h, shared in zip(*(b.column(i).to_pylist() for i in range(3))):
                    out += [(d, h, s, e) for s, e in aligned_blocks([tuple(x.values()) for x in shared])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["d", "h", "start", "end"])

    cut = pairs.select("b.d", "b.h", "shared").mapInArrow(cut_pairs, "d long, h long, start long, end long")
    return stored(cut.groupBy("d", "h").agg(F.collect_set(F.struct("start", "end")).alias("cut")), "cuts")


def dedup_lines(docs: DataFrame, line_words: int = LINE_WORDS, block_words: int = BLOCK_WORDS,
                lines_col: str = "n_lines", deleted_col: str = "n_deleted") -> DataFrame:
    """``docs`` with duplicate blocks of lines deleted from ``text``; appends each document's lines before and how
    many of them went."""
    gd, gh, gcut, dd, hh, kept_col, lines_col, deleted_col = free(docs, "d", "h", "cut", "dd", "hh", "kept", lines_col, deleted_col)
    cut = deletions(docs, line_words, block_words).select(F.col("d").alias(gd), F.col("h").alias(gh), F.col("cut").alias(gcut))
    d, h = key_columns()
    # texts always meet the deletions in a merge join, whatever size the deletions have here
    cut = cut.hint("merge")
    j = docs.withColumn(dd, d).withColumn(hh, h).join(cut, (F.col(dd) == F.col(gd)) & (F.col(hh) == F.col(gh)), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists(gcut, lambda c: (c["start"] <= i) & (i < c["end"])))
    j = j.withColumn(kept_col, F.when(F.col(gcut).isNotNull(), kept))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    j = j.withColumn(lines_col, total.cast("bigint"))
    j = j.withColumn(deleted_col, F.when(F.col(kept_col).isNull(), 0).otherwise(F.col(lines_col) - F.size(kept_col)).cast("bigint"))
    text = F.when(F.col(kept_col).isNull(), F.col("text")).otherwise(F.array_join(kept_col, "\n"))
    return j.withColumn("text", text).select(*docs.columns, lines_col, deleted_col)
