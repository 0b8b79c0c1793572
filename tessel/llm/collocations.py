"""Phrase collocations by direct-address tiling.

1. Tasks cut their texts into blocks of one language and some 500,000 words: the block's
   distinct words with counts, and its word sequence as numbers into that list
   (-1 between pieces). Written once.
2. Counts of all blocks are added up; words of at least ``min_count`` are numbered by falling
   frequency. No phrase that counts can hold a rarer word.
3. Each block learns the numbers of its own words by a join, and counts adjacent pairs by
   tiles of ``TILE`` x ``TILE`` numbers: a tile with many pairs of the block is counted in a
   dense array by bincount, all others as sorted coordinates.
   Frequent words have small numbers, so most pairs lie in few dense tiles.
4. Pairs of all blocks meet in buckets of some ``BUCKET_PAIRS`` of them, as packed sorted columns, and are added up. Frequent
   pairs are numbered in their turn, by classes of falling frequency, and each block is told the
   numbers of its own ones; adjacent numbers of *overlapping* pairs are phrases of three words: step 3
   again, and so on up to ``max_words``.

No table of all words or pairs is ever in one task or broadcast by order: a block meets
only its own entries, a bucket holds a bounded number of words' pairs. Counts are combined in the block before any shuffle. Every level
carries its phrases' words and the counts of all their prefixes and suffixes,
which is what the cuts need.

Defined results: null and empty texts have no words; a null language is ``und`` (together with
documents so marked); repeated rows count again; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import arrow_slices, byte_texts, stored

#: Words after which a block ends, at the next end of a piece.
BLOCK_WORDS = 1 << 19
#: Words that all open blocks of a task may hold together.
OPEN_WORDS = 1 << 20
#: Bytes of text made into Python words at a time.
CHUNK_BYTES = 1 << 20
TILE = 512
#: A tile is dense when a block has this many pairs in it.
DENSE_PAIRS = TILE * TILE // 8
#: Pairs come to buckets, one for so many words of the corpus.
BUCKET_PAIRS = 1 << 20
#: Classes of frequency, two for each doubling; numbers go by class, the most frequent first.
CLASSES = 64
#: First step of the per-language ranking: independent parts of a language.
RANK_PARTS = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 0x2E if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b for b in range(256))


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes, 4 or 8 bytes each."""
    a = np.ascontiguousarray(a, np.int64)
    small = not len(a) or (a.min() >= -(1 << 31) and a.max() < 1 << 31)
    planes = a.astype(np.int32 if small else np.int64).view(np.uint8).reshape(len(a), -1).T
    return (b"4" if small else b"8") + zstandard.compress(planes.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    width = int(raw[:1])
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(np.int32 if width == 4 else np.int64).ravel().astype(np.int64)


def chunks(raw: bytes, size: int = CHUNK_BYTES) -> Iterator[tuple[list[bytes], bool]]:
    """Words of a lower-cased text, ``b"."`` where a piece ends, some MB at a time; whether a chunk ends a piece."""
    t, at = raw.translate(_LOWER), 0
    while at < len(t):
        end, whole = len(t), True
        if end - at > size:
            end = t.rfind(b".", at, at + size) + 1
            if end <= at:
                whole = False
                end = t.rfind(b" ", at, at + size) + 1
            if end <= at:  # a word longer than a chunk
                ends = [x for x in (t.find(b" ", at + size), t.find(b".", at + size)) if x >= 0]
                end = min(ends) + 1 if ends else len(t)
                whole = end == len(t) or t[end - 1:end] == b"."
        yield t[at:end].replace(b".", b" . ").split(), whole
        at = end


class Blocks:
    """Open blocks of a task, one a language."""

    def __init__(self, limit: int):
        self.limit, self.open, self.held, self.total = limit, {}, {}, 0

    def add(self, lang: str, words: list[bytes]) -> None:
        if words:
            self.open.setdefault(lang, []).append(pa.array(words, pa.binary()).dictionary_encode())
            self.held[lang] = self.held.get(lang, 0) + len(words)
            self.total += len(words)

    def full(self, lang: str) -> bool:
        return self.held.get(lang, 0) >= self.limit

    def close(self, lang: str) -> tuple | None:
        """Language, distinct words, counts, sequence."""
        parts = self.open.pop(lang, None)
        self.total -= self.held.pop(lang, 0)
        if parts is None:
            return None
        whole = pa.chunked_array(parts).unify_dictionaries()
        words = whole.chunk(whole.num_chunks - 1).dictionary
        seq = np.concatenate([np.asarray(c.indices) for c in whole.chunks]).astype(np.int32)
        n = np.bincount(seq, minlength=len(words))
        number, real = np.arange(len(words), dtype=np.int32), np.ones(len(words), bool)
        dot = pc.index(words, pa.scalar(b".", pa.binary())).as_py()
        if dot >= 0:
            number[dot], number[dot + 1:] = -1, number[dot + 1:] - 1
            real[dot] = False
        words, n = words.filter(pa.array(real)), n[real]
        return (lang, words.cast(pa.string()), n, number[seq]) if len(words) else None


def with_sequence(block: int, columns: dict, seq: np.ndarray) -> pa.RecordBatch:
    """Rows of one block, a distinct entry each; the first one also has the block's sequence."""
    k = len(next(iter(columns.values())))
    return pa.RecordBatch.from_pydict({"block": pa.array(np.full(k, block)), "item": pa.array(np.arange(k, dtype=np.int32)), **columns,
                                       "seq": pa.array([pack(seq)] + [None] * (k - 1), pa.binary())})


def word_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``block, item, lang, word, n, seq``: the distinct words of each block, numbered from 0, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, blocks = TaskContext.get().partitionId() << 32, 0, Blocks(block_words)

        def row(closed):
            nonlocal made
            made += 1
            lang, words, n, seq = closed
            return with_sequence(base + made, {"lang": pa.array([lang] * len(words)), "word": words, "n": pa.array(n)}, seq)

        for b in arrow_slices(batches):
            texts: dict[str, list[bytes]] = {}
            for lang, raw in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
                texts.setdefault(lang, []).append(raw)
            for lang, raws in texts.items():
                for words, whole in chunks(b".".join(raws) + b"."):
                    blocks.add(lang, words)
                    if whole and blocks.full(lang):
                        closed = blocks.close(lang)
                        if closed:
                            yield row(closed)
            if blocks.total >= OPEN_WORDS:
                yield from (row(c) for c in map(blocks.close, list(blocks.open)) if c)
            pa.default_memory_pool().release_unused()
        yield from (row(c) for c in map(blocks.close, list(blocks.open)) if c)

    src = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    return src.mapInArrow(run, "block long, item int, lang string, word string, n long, seq binary")


def count_pairs(left: np.ndarray, right: np.ndarray, tile: int = TILE, dense: int = DENSE_PAIRS) -> tuple[np.ndarray, ...]:
    """Distinct pairs (left, right), their counts, and for each given pair its place among them."""
    which = np.empty(len(left), np.int32)
    rows, row = np.unique(left // tile, return_inverse=True)
    cols, col = np.unique(right // tile, return_inverse=True)
    tiles, at_tile, size = np.unique(row * len(cols) + col, return_inverse=True, return_counts=True)
    cell = (left % tile) * tile + right % tile
    out, made = [], 0

    def add(tile_no, cells, n):
        nonlocal made
        out.append((rows[tile_no // len(cols)] * tile + cells // tile, cols[tile_no % len(cols)] * tile + cells % tile, n))
        made += len(cells)

    for t in np.flatnonzero(size >= dense):
        at = np.flatnonzero(at_tile == t)
        n = np.bincount(cell[at], minlength=tile * tile)
        used = np.flatnonzero(n)
        number = np.empty(tile * tile, np.int32)
        number[used] = np.arange(made, made + len(used), dtype=np.int32)
        which[at] = number[cell[at]]
        add(np.full(len(used), tiles[t]), used, n[used])
    at = np.flatnonzero((size < dense)[at_tile])
    if len(at):
        at = at[np.lexsort((cell[at], at_tile[at]))]
        new = np.concatenate([[True], (np.diff(at_tile[at]) != 0) | (np.diff(cell[at]) != 0)])
        first = np.flatnonzero(new)
        which[at] = made + np.cumsum(new) - 1
        add(tiles[at_tile[at[first]]], cell[at[first]], np.diff(np.append(first, len(at))))
    if not out:
        return (*(np.empty(0, np.int64),) * 3, which)
    return (*(np.concatenate(c).astype(np.int64) for c in zip(*out)), which)


def pair_items(ids: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """A numbered sequence's distinct adjacent pairs by bucket: left, right, count, bucket; and the sequence of
    their places in that list (-1 where there is no pair)."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    left, right, n, which = count_pairs(ids[at], ids[at + 1])
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    bucket = ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((right, left, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    seq = np.full(len(ids), -1, np.int64)
    seq[at] = place[which]
    return left[order], right[order], n[order], bucket[order], seq


def packed(known: DataFrame) -> DataFrame:
    """``block, item, id`` rows as packed columns, a row for each block in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1))
            parts = np.split(order, cuts[1:])
            item, ids = b.column(1).to_numpy(), b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(block[order[cuts]]), pa.array([pack(item[x]) for x in parts], pa.binary()),
                                              pa.array([pack(ids[x]) for x in parts], pa.binary())], names=["block", "items", "ids"])

    return known.select("block", "item", "id").mapInArrow(run, "block long, items binary, ids binary")


def renumbered(blocks: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """``block, seq``: sequences of ``blocks`` with each entry's number (-1: none). ``known`` has ``block, items, ids``, packed
    places and numbers; the entries are the sequence's own values, or its pairs if there are ``buckets``."""

    def done(block, seq, items, ids):
        if not items:
            return
        if buckets:
            seq = pair_items(seq, buckets)[-1]
        number = np.full(int(seq.max(initial=-1)) + 2, -1, np.int64)  # the last one serves -1
        number[np.concatenate(items)] = np.concatenate(ids)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pack(number[seq])], pa.binary())], names=["block", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, items, ids = None, None, [], []
        for b in batches:
            for block, i, n, s in zip(*(b.column(k).to_pylist() for k in range(4))):
                if s is not None:  # a block's sequence comes first
                    yield from done(now, seq, items, ids)
                    now, seq, items, ids = block, unpack(s), [], []
                else:
                    items.append(unpack(i))
                    ids.append(unpack(n))
        yield from done(now, seq, items, ids)

    none = F.lit(None).cast("binary")
    rows = blocks.select("block", none.alias("items"), none.alias("ids"), "seq").unionAll(known.select("block", "items", "ids", none.alias("seq")))
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("seq").isNull())
    return rows.mapInArrow(run, "block long, seq binary")


MERGED = "kind int, part int, block long, a binary, b binary, c binary, d binary, e binary, counts array<long>"


def frequent_pairs(blocks: DataFrame, buckets: int, min_count: int) -> DataFrame:
    """Adjacent pairs of numbered blocks that occur ``min_count`` times or more. Packed rows: kind 0 tells a block which of its pairs
    (a) they are, by class (b) and place (c) in the class within the task (``part``); kind 1 has left (a), right (b), count (c), class
    and place (d, e); kind 2 the task's number of pairs in each class."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                left, right, n, bucket, _ = pair_items(unpack(raw), buckets)
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(first[1:], len(bucket))
                if len(first):
                    cols = [pa.array([pack(x[s:e]) for s, e in zip(first, ends)], pa.binary()) for x in (left, right, n)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([block] * len(first)), pa.array(first), *cols],
                                                     names=["bucket", "block", "first", "left", "right", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), np.zeros(CLASSES, np.int64)
        now, held = None, []

        def rows(kind, block, *cols, counts=None):
            k = len(cols[0]) if cols else 1
            blobs = [pa.array(c, pa.binary()) for c in cols] + [pa.nulls(k, pa.binary())] * (5 - len(cols))
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * k, pa.int32()), pa.array([part] * k, pa.int32()), pa.array(block if block is not None else [None] * k, pa.int64()), *blobs,
                 pa.array([counts] * k, pa.list_(pa.int64()))], names=["kind", "part", "block", "a", "b", "c", "d", "e", "counts"])

        def bucket_done():
            if not held:
                return
            left, right, n = (np.concatenate([unpack(x[i]) for x in held]) for i in (2, 3, 4))
            size = [len(unpack(x[4])) for x in held]
            owner = np.repeat(np.arange(len(held)), size)
            item = np.concatenate([np.arange(k) + x[1] for k, x in zip(size, held)])
            order = np.lexsort((right, left))
            new = np.append(True, (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0))
            first, group = np.flatnonzero(new), np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            f = np.add.reduceat(n[order], first)
            some = f >= min_count
            if not some.any():
                return
            kind = np.full(len(f), -1, np.int64)
            kind[some] = CLASSES - 1 - np.minimum(CLASSES - 1, (2 * np.log2(f[some])).astype(np.int64))
            place = np.zeros(len(f), np.int64)
            for c in np.unique(kind[some]):
                at = np.flatnonzero(kind == c)
                place[at] = made[c] + np.arange(len(at))
                made[c] += len(at)
            at = first[some]
            yield rows(1, None, *([pack(x)] for x in (left[order][at], right[order][at], f[some], kind[some], place[some])))
            mine = np.flatnonzero(some[group])  # in order of the blocks
            cuts = np.flatnonzero(np.diff(owner[mine], prepend=-1))
            parts = np.split(mine, cuts[1:])
            yield rows(0, [held[owner[x[0]]][0] for x in parts], [pack(item[x]) for x in parts], [pack(kind[group[x]]) for x in parts],
                       [pack(place[group[x]]) for x in parts])

        for b in batches:
            for bucket, *rest in zip(*(b.column(k).to_pylist() for k in range(6))):
                if bucket != now:
                    yield from bucket_done()
                    now, held = bucket, []
                held.append(rest)
        yield from bucket_done()
        yield rows(2, None, counts=made.tolist())

    met = blocks.select("block", "seq").mapInArrow(pairs, "bucket long, block long, first long, left binary, right binary, n binary")
    return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, MERGED)


def with_numbers(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (``id, left, right, f``) and what each block knows of them (``block, items, ids``) of ``frequent_pairs``."""
    sizes = merged.where("kind = 2").select("part", F.posexplode("counts").alias("class", "n"))
    # CLASSES rows per task of the merge
    before = Window.orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = base.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("class", "base"))).alias("x")).select("part", F.col("x.base").alias("base"))
    rows = merged.where("kind < 2").join(F.broadcast(base), "part")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for left, right, f, kind, place, base in zip(*(b.column(k).to_pylist() for k in range(6))):
                ids = np.array(base)[unpack(kind)] + unpack(place)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, unpack(left), unpack(right), unpack(f))], names=["id", "left", "right", "f"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [pack(np.array(base)[unpack(kind)] + unpack(place)) for kind, place, base in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["block", "items", "ids"])

    return (rows.where("kind = 1").select("a", "b", "c", "d", "e", "base").mapInArrow(pairs, "id long, left long, right long, f long"),
            rows.where("kind = 0").select("block", "a", "b", "c", "base").mapInArrow(tell, "block long, items binary, ids binary"))


def numbered(df: DataFrame, name: str, *ties: str) -> DataFrame:
    """``df`` with ``id``: 0, 1, 2, ... by falling ``f``. One range-partitioned sort; a partition's rows are
    numbered where they lie, and only the partitions' sizes are added up."""
    s = df.sort(F.desc("f"), F.xxhash64(*ties), *ties)
    s = stored(s.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    before = s.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition of the sort
    return s.join(F.broadcast(before.select("part", "before")), "part").withColumn("id", F.col("before") + F.col("at")).drop("part", "at", "before")


def levels(docs: DataFrame, max_words: int, min_count: int, block_words: int = BLOCK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of phrases of 1 ... ``max_words`` words that occur ``min_count`` times or more: ``id, lang, words, f,
    prefix, suffix`` (counts of the first and of the last 1, 2, ... words) and ``left, right`` (ids of the phrase
    without its last and without its first word); and each language's words."""
    blocks = stored(word_blocks(docs, block_words), "blocks")
    total = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    words = int(total.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    buckets = max(1, -(-words // BUCKET_PAIRS))
    counted = blocks.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    # narrow, so that Spark's own size check may broadcast it to the blocks
    level = stored(numbered(counted, "counted", "lang", "word").select("id", "lang", "word", "f"), "numbered")
    out = [level.select("id", "lang", F.array("word").alias("words"), "f", F.array("f").alias("prefix"), F.array("f").alias("suffix"))]
    known = packed(blocks.select("block", "item", "lang", "word").join(level.select("id", "lang", "word"), ["lang", "word"]))
    seqs, entries = blocks.where("seq IS NOT NULL"), 0
    for k in range(2, max_words + 1):
        seqs = stored(renumbered(seqs, known, entries), f"sequences-{k}")
        level, known = with_numbers(stored(frequent_pairs(seqs, buckets, min_count), f"pairs-{k}"))
        entries = buckets
        a = out[-1].select(F.col("id").alias("left"), "lang", F.col("words").alias("w"), F.col("prefix").alias("p"))
        b = out[-1].select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"), F.col("suffix").alias("s"))
        out.append(stored(level.join(a, "left").join(b, "right").select(
            "id", "left", "right", "lang", F.concat("w", F.array("last")).alias("words"), "f",
            F.concat("p", F.array("f")).alias("prefix"), F.concat("s", F.array("f")).alias("suffix")), f"level-{k}"))
    return out, total


def weakest_cut(k: int):
    """(score, cut, l, r) of the cut of a ``k``-word phrase with the lowest score, the smallest cut at ties."""
    def big(c):
        return c.cast("decimal(18,0)")

    cuts = []
    for cut in range(1, k):
        left, right = F.col("prefix")[cut - 1], F.col("suffix")[k - cut - 1]
        score = F.call_function("div", big(F.col("f")) * big(F.col("f")) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right))
        cuts.append(F.struct(score.cast("bigint").alias("score"), F.lit(cut).alias("cut"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, covered_percent: int = 50, per_lang: int = 2000,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``per_lang`` best phrases of 2 to ``max_words`` words.
    A phrase's score is that of its weakest cut, 1000000 a a / (l r) rounded down; one that a longer
    candidate covers to ``covered_percent`` or more is left out."""
    tables, total = levels(docs, max_words, min_count, block_words)
    parts = []
    for k in range(2, max_words + 1):
        level = tables[k - 1].withColumn("c", weakest_cut(k)).select("id", "lang", "words", F.col("f").alias("a"), "c.score", "c.l", "c.r")
        if k < max_words:
            longer = tables[k]
            cover = longer.select(F.col("left").alias("id"), "f").unionAll(longer.select("right", "f")).groupBy("id").agg(F.max("f").alias("cover"))
            level = level.join(cover, "id", "left").where(F.col("cover").isNull() | (100 * F.col("cover") < covered_percent * F.col("a")))
        parts.append(level.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each part of a language, then of the language: a language is never sorted whole
    best = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= per_lang)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= per_lang)
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS ph FROM w, (VALUES (1), (2), (3)) t(k)),
g AS MATERIALIZED (SELECT lang, k, ph, count(*) AS f FROM o GROUP BY ALL),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 10),
u AS MATERIALIZED (SELECT lang, k, ph, f AS a, cut, ph[1:cut] AS first, ph[cut + 1:k] AS rest FROM c, (VALUES (1), (2)) t(cut) WHERE cut < k),
v AS MATERIALIZED (SELECT u.*, g.f AS l FROM u JOIN g ON g.lang = u.lang AND g.ph = u.first),
s AS (SELECT v.lang, v.k, v.ph, a, l, g.f AS r, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * g.f) AS BIGINT) AS score
  FROM v JOIN g ON g.lang = v.lang AND g.ph = v.rest
  QUALIFY row_number() OVER (PARTITION BY v.lang, v.ph ORDER BY score, cut) = 1),
cover AS (SELECT lang, ph, max(f) AS f FROM (SELECT lang, ph[1:2] AS ph, f FROM c WHERE k = 3 UNION ALL SELECT lang, ph[2:3], f FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT s.lang, array_to_string(s.ph, ' ') AS phrase, a, l, r, score FROM s LEFT JOIN cover USING (lang, ph) WHERE cover.f IS NULL OR 100 * cover.f < 50 * a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
