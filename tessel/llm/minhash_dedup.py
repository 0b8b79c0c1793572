"""MinHash near-duplicates with circulant signatures.

A text's set holds its distinct word shingles as 64-bit numbers. Circulant
MinHash needs two permutations: the first (sigma) places a shingle on a ring
of 2^32 positions, the second (pi, a bijective mixer of 32-bit numbers) is used
shifted: coordinate k of the signature is min over the set of pi(sigma(x) - k).
Bands of coordinates are hashed to bucket keys.

1. One pass over the texts writes, per document, its set's number and size and
   its bucket keys. Documents with equal sets form a class; only one row a class goes on.
2. In each bucket all classes meet the one with the smallest number (a star, so
   a bucket of n classes gives n - 1 pairs). Pairs are verified on full sets
   recomputed from whole texts: 100 * |A and B| >= percent * |A or B|.
3. Verified links give components. Buckets whose classes are then still in several
   components are looked at again, and pairs across components are compared, each
   in the first bucket the two share: as pairs in a bucket of up to
   ``small`` classes, else in blocks. There the classes outside the bucket's main
   component form blocks, and all classes of the bucket, in slices, stream past each block.

So every pair that shares a bucket is either verified or already connected. With
36 bands of 5 a pair at Jaccard 0.8 shares no bucket with probability 6e-7.

Hot keys: copies collapse before anything is joined; a star's members are
dealt over salts of about ``salt_rows`` members, each with the centre's text, and
compared one by one as they stream by, so no task holds a group. Blocks are
bounded in classes and in shingles.

Defined results: words are split at ASCII white space, A-Z lower-cased; a text of
fewer words than a shingle is one shingle; a text without words (or null) has an
empty set and links with nothing. Repeated rows, and rows that share a doc_id with
other texts, are documents of their own; a null doc_id is never a component's
id unless all its members are null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import arrow_slices, byte_texts, count_rows, free, long_key, stored
from tessel.llm.graph import components

BANDS, ROWS, SMALL, SALT_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 36, 5, 24, 64, 128, 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle numbers of one whole text."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = min(n, k)
    h = np.full(n - m + 1, np.uint64(m))
    for i in range(m):
        h = mix64(h * _MUL + w[i:n - m + 1 + i])
    return np.unique(h)


def set_number(s: np.ndarray) -> int:
    """64-bit number of a whole set (signed, as Spark's long)."""
    d = xxhash.xxh3_64_intdigest(s.tobytes())
    return d - (1 << 64) if d >> 63 else d


def ring_mix(x: np.ndarray) -> np.ndarray:
    """pi: a bijective mixer of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x21F0AAAD)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x735A2D97)
    x ^= x >> np.uint32(15)
    return x


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The first ``count`` coordinates of every (non-empty) set's signature."""
    ring = (mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)  # sigma
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(ring_mix(ring - np.uint32(k)), starts)
    return out


def bucket_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64) * _MUL), (len(sig), bands)).copy()
    for i in range(rows):
        key = mix64(key * _MUL + parts[:, :, i])
    return key.view(np.int64)


def describe(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, h, n_shingles, set_id, keys`` per document; ``h`` is the text's hash, ``keys`` is null for an empty set."""

    def groups(sets: list[np.ndarray], most: int = 1 << 18) -> Iterator[list[int]]:
        held, size = [], 0
        for i, s in enumerate(sets):
            if len(s):
                held.append(i)
                size += len(s)
                if size >= most:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_slices(batches):
            sets = [shingle_set(t, k) for t in byte_texts(b.column(1))]
            keys: list = [None] * len(sets)
            for part in groups(sets):
                got = bucket_keys(signatures([sets[i] for i in part], bands * rows), bands, rows)
                for i, row in zip(part, got):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_number(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "n_shingles", "set_id", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("h")).mapInArrow(
        run, "doc_id long, h long, n_shingles long, set_id long, keys array<long>")


def text_hash():
    """A text's hash in Spark; null has one of its own."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("\x00")))


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, salt_rows: int) -> DataFrame:
    """The pairs (a, b: set numbers) that hold on full sets. The text of ``b`` streams
    past the text of ``a``; a centre ``a`` of many pairs is copied to its salts."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("salts"))
    place = classes.select(F.col("set_id").alias("set"), "doc", "h")
    members = (pairs.join(salts, "a").select(F.col("b").alias("set"), F.col("a").alias("centre"),
                                            F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role")))
    centres = salts.select(F.col("a").alias("set"), F.col("a").alias("centre"),
                           F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = members.unionByName(centres).join(place, "set")
    texts = docs.select(long_key(F.col("doc_id")).alias("doc"), text_hash().alias("h"), F.col("text").cast("string").alias("text"))
    rows = (wanted.join(texts, ["doc", "h"]).select("text", "set", "centre", "salt", "role")
            .repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in arrow_slices(batches):
            a_out, b_out = [], []
            for raw, number, centre, salt, role in zip(byte_texts(b.column(0)), *(b.column(i).to_pylist() for i in range(1, 5))):
                s = shingle_set(raw, k)
                if set_number(s) != number:
                    continue  # another text of the same id and hash
                if role == 0:
                    at, held = (centre, salt), s
                elif at == (centre, salt):
                    if 100 * min(len(s), len(held)) < percent * max(len(s), len(held)):
                        continue
                    both = len(np.intersect1d(s, held, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(held) - both):
                        a_out.append(centre)
                        b_out.append(number)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def stars(buckets: DataFrame) -> DataFrame:
    """``key, set_id, centre, n`` for the members of every bucket of two or more classes."""
    top = buckets.groupBy("key").agg(F.min("set_id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return buckets.join(stored(top, "centres"), "key")  # a table of its own: adaptive execution may split a hot key


def labelled(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """Buckets with each class's component, kept only where a bucket has several."""
    c = comp.select(F.col("id").alias("set_id"), "component")
    b = buckets.join(c, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    mixed = (b.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
             .where("lo != hi").select("key", "size"))
    return b.join(mixed, "key")


def cross_pairs(b: DataFrame) -> DataFrame:
    """Pairs across components inside small buckets."""
    x = b.select("key", F.col("set_id").alias("a"), F.col("component").alias("ca"))
    y = b.select("key", F.col("set_id").alias("b"), F.col("component").alias("cb"))
    return x.join(y, "key").where("a < b AND ca != cb").select("a", "b")


class Block:
    """Sets held against a stream of sets: counts common shingles with all at once."""

    def __init__(self, sets: list[np.ndarray], numbers: list[int], comps: list[int], keys: list[list[int]]):
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        self.size = np.array([len(s) for s in sets])
        self.numbers, self.comps, self.keys = np.array(numbers), np.array(comps), np.array(keys)

    def links(self, s: np.ndarray, number: int, comp: int, keys: list[int], main: int, at: int, percent: int) -> np.ndarray:
        """Numbers of the held sets linked with ``s``, among those whose first common bucket is keys[at]."""
        same = self.keys == np.array(keys)
        mine = (self.comps != comp) & (same.argmax(1) == at) & same.any(1) & ((comp == main) | (self.numbers < number))
        if not mine.any():
            return self.numbers[:0]
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        n = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[rows], minlength=len(self.size))
        return self.numbers[mine & (100 * both >= percent * (self.size + len(s) - both))]


def verify_blocks(large: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, block_rows: int) -> DataFrame:
    """Links across components inside large buckets (``key, set_id, component``)."""
    per = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    place = classes.select("set_id", "doc", "h", "keys", "n_shingles")
    rows = large.select("key", "set_id", "component").join(main, "key").join(place, "set_id")
    stray = rows.where("component != main")
    blocks = stray.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
                                      .cast("int").alias("blocks"))
    slices = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).cast("int").alias("slices"))
    blocks = blocks.join(slices, "key")
    part = lambda n, seed: F.pmod(F.xxhash64("set_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = (stray.join(blocks, "key").withColumn("block", part("blocks", 1)).withColumn("slice", every("slices")).withColumn("role", F.lit(0)))
    passing = (rows.join(blocks, "key").withColumn("block", every("blocks")).withColumn("slice", part("slices", 2)).withColumn("role", F.lit(1)))
    texts = docs.select(long_key(F.col("doc_id")).alias("doc"), text_hash().alias("h"), F.col("text").cast("string").alias("text"))
    wanted = held.unionByName(passing).select("key", "block", "slice", "role", "set_id", "component", "main", "doc", "h", "keys")
    rows = (wanted.join(texts, ["doc", "h"]).select("text", "key", "block", "slice", "role", "set_id", "component", "main", "keys")
            .repartition("key", "block", "slice").sortWithinPartitions("key", "block", "slice", "role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, wait, block = None, [], None
        for b in arrow_slices(batches):
            a_out, b_out = [], []
            for raw, key, at, cut, role, number, comp, top, keys in zip(byte_texts(b.column(0)), *(b.column(i).to_pylist() for i in range(1, 9))):
                s = shingle_set(raw, k)
                if set_number(s) != number:
                    continue
                if unit != (key, at, cut):
                    unit, wait, block = (key, at, cut), [], None
                if role == 0:
                    wait.append((s, number, comp, keys))
                elif wait:
                    block = block or Block(*zip(*wait))
                    for other in block.links(s, number, comp, keys, top, keys.index(key), percent).tolist():
                        a_out.append(other)
                        b_out.append(number)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                small: int = SMALL, salt_rows: int = SALT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, h, n_shingles, group, component_id`` per document: ``group`` names its component
    (null for an empty set), ``component_id`` is the component's smallest doc_id."""
    docs = docs.select("doc_id", "text")
    sig = stored(describe(docs, k, bands, rows), "sets")
    full = sig.where(F.col("keys").isNotNull())
    classes = stored(full.groupBy("set_id").agg(
        F.min(F.struct(long_key(F.col("doc_id")).alias("doc"), "h")).alias("at"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"),
        F.max("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")).select("*", "at.doc", "at.h").drop("at"), "classes")
    buckets = classes.select("set_id", F.explode("keys").alias("key"))
    starred = stored(stars(buckets), "buckets")
    edges = stored(verify(starred.where("set_id != centre").select(F.col("centre").alias("a"), F.col("set_id").alias("b")),
                          classes, docs, k, percent, salt_rows), "links")
    comp = components(edges)
    mixed = stored(labelled(starred.select("key", "set_id"), comp), "mixed")
    more = verify(cross_pairs(mixed.where(F.col("size") <= small)), classes, docs, k, percent, salt_rows)
    large = mixed.where(F.col("size") > small)
    if count_rows(large):
        more = more.unionByName(verify_blocks(large, classes, docs, k, percent, block_rows))
    # the components so far are edges as good as the links they came from
    comp = components(more.unionByName(comp.select(F.col("component").alias("a"), F.col("id").alias("b"))))
    # the smallest doc_id over all members of all classes of a component
    of = classes.join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").select(
        "set_id", "least", "copies", F.coalesce("component", "set_id").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    groups = stored(of.join(least, "component").select("set_id", "component", "component_id"), "groups")
    out = sig.select("doc_id", "h", "n_shingles", "set_id").join(groups, "set_id", "left")
    group = F.when(F.col("n_shingles") > 0, F.coalesce("component", "set_id"))
    return out.select("doc_id", "h", "n_shingles", group.alias("group"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, **how) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document."""
    return near_groups(docs, k, percent, **how).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, **how) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (null last), then text hash. Documents
    with an empty set all stay. Texts move once, to meet the narrow table of winners."""
    found = stored(near_groups(docs, k, percent, **how), "near")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), long_key(F.col("doc_id")).alias("doc"), F.col("h"))
    best = found.where("group IS NOT NULL").groupBy("group").agg(F.min(key).alias("w")).select("w.doc", "w.h", F.lit(False).alias("all"))
    empty = found.where("group IS NULL").select(long_key(F.col("doc_id")).alias("doc"), "h", F.lit(True).alias("all")).distinct()
    doc, h, all_, no = free(docs, "doc", "h", "all", "no")
    keep = best.unionByName(empty).withColumnsRenamed({"doc": doc, "h": h, "all": all_})
    j = docs.withColumn(doc, long_key(F.col("doc_id"))).withColumn(h, text_hash()).join(keep, [doc, h])
    w = Window.partitionBy(doc, h).orderBy(all_)
    return j.withColumn(no, F.row_number().over(w)).where(F.col(all_) | (F.col(no) == 1)).select(*docs.columns)
