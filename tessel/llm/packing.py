"""Packing: best-fit decreasing with a segment tree over remaining capacities.

Each document is tokenised (tokenizer ids, then one end id) and cut into full
windows of ``seq_len`` ids plus one shorter rest. A full window is a sequence of
its own; rests are packed best-fit decreasing. The tree's leaves are the possible
remaining capacities 0..seq_len; a node holds how many open windows lie
below it, so the tightest window that takes a piece is one walk down the tree.

Distribution: token ids never leave the task that made them; only narrow piece
rows (id, start, length, crc) are written. Piece rows are dealt by the hash of a
unique row key to shards of about ``shard_pieces`` pieces, and one task packs one
shard, so a shard's size does not depend on ids, sources or copies. A shard
leaves at most a few windows half empty.

Defined results: null text is empty (one piece holding the end id); repeated
ids or rows are packed as separate documents; a null doc_id stays null; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import arrow_slices, byte_texts, count_rows, stored

SEQ_LEN = 2048
END_ID = 1
SHARD_PIECES = 8192
#: Words in the younger of a worker's two cache generations.
CACHE_WORDS = 250_000


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes a byte: printable ones as themselves, the others
    in order from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(rest)}


class WordEncoder:
    """Token ids of white-space separated words, remembered as packed uint32.

    Valid for tokenizers that drop white space and never merge across it, so
    that a text's ids are its words' ids in order. A word of ASCII or Latin-1
    letters goes straight to the BPE model, in the spelling that the normaliser and
    the byte-level step give it (checked against the whole tokenizer when
    the encoder is made); a comma or full stop after a letter is a token run of its
    own and is split off first. All other words pass the whole tokenizer.
    """

    _letters = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.bytes_as = _byte_letters()
        self.cache_words = cache_words
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the generation before: what is used again moves up, the rest goes
        probe = ["Hello", "na\u00efve", "\u00c9T\u00c9", "stra\u00dfe", "x", "thingtionre"]
        self.direct = all(self._word(w) == self._whole([w])[0] for w in probe) and all(
            self._whole([w + m])[0] == self._word(w) + self._whole([m])[0] for w in probe for m in ".,")

    def _word(self, word: str) -> bytes:
        spelt = word.lower().encode().decode("latin-1").translate(self.bytes_as)
        ids = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        cache, other = self.cache, []
        marks = dict(zip((".", ","), self._whole([".", ","])))
        for w in words:
            text = w.decode("utf-8", "replace")
            stem, end = (text[:-1], text[-1]) if text[-1] in marks else (text, "")
            if not (self.direct and self._letters(stem)):
                other.append(w)
                continue
            key = stem.lower().encode()
            ids = cache.get(key)
            if ids is None:
                ids = cache[key] = self._word(stem)
            cache[w] = ids + marks[end] if end else ids
        for at in range(0, len(other), 2000):
            part = other[at:at + 2000]
            cache.update(zip(part, self._whole([x.decode("utf-8", "replace") for x in part])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Per text its ids as little-endian uint32 bytes."""
        split = [t.split() for t in texts]
        words = set().union(*split) if split else set()
        if len(self.cache) > self.cache_words:
            self.older, self.cache = self.cache, {}
        new = words.difference(self.cache)
        if self.older:
            again = new.intersection(self.older)
            self.cache.update((w, self.older[w]) for w in again)
            new -= again
        if new:
            self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker: its words serve all tasks that run in it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("row", pa.int64())])


def document_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: full windows and the rest of each document."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        row = TaskContext.get().partitionId() << 40
        for b in arrow_slices(batches):
            out: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(byte_texts(b.column(1)))):
                ids += end
                n = len(ids) // 4
                view = memoryview(ids)
                for at in range(0, n, seq_len):
                    piece = view[4 * at:4 * min(n, at + seq_len)]
                    out.append((doc, at, len(piece) // 4, zlib.crc32(piece), n, row))
                    row += 1
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, PIECES)], schema=PIECES)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")


class CapacityTree:
    """Segment tree over remaining capacity; ``take(n)`` gives the tightest open
    window with room for ``n`` ids, or None."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, leaf: int, by: int) -> None:
        i = leaf + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, left: int, window: int) -> None:
        if left:
            self.open[left].append(window)
            self._add(left, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # climb to the next non-empty subtree to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        left = i - self.size
        window = self.open[left].pop()
        self._add(left, -1)
        return left, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int = SEQ_LEN) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; longest first, ties in given order."""
    tree = CapacityTree(capacity)
    window, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        left, w = found if found else (capacity, used)
        used += found is None
        window[i], offset[i] = w, capacity - left
        tree.put(left - n, w)
    return window, offset


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece."""
    pieces = stored(document_pieces(docs, tokenizer_path, seq_len, end_id), "pieces")
    shards = max(1, -(-count_rows(pieces) // shard_pieces))

    def pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        window, offset = best_fit_decreasing(pdf["length"].to_numpy(), seq_len)
        pdf["sequence_id"] = (pdf["shard"].to_numpy(np.int64) << 32) + window
        pdf["offset"] = offset
        return pdf.drop(columns=["row", "shard"])

    return (pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("bigint"))
            .groupBy("shard").applyInPandas(pack_shard, "doc_id long, start long, length long, ids_crc32 long, "
                                                        "doc_tokens long, sequence_id long, offset long"))
