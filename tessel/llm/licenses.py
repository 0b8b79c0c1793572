"""Licence scan: fuzzy search for short notices.

A text becomes its words (A-Z lower-cased, ASCII other than letters and digits
parts them) joined by single spaces. A notice of ``errors`` allowed edits is cut
into ``errors + 1`` pieces: whatever the edits, one piece stands unharmed
(pigeonhole). One Aho-Corasick pass over the text finds every piece of every
notice; pieces on neighbouring diagonals form one window, little longer than the
notice, and the ``regex`` library's bounded-error matching decides it, with
the fewest edits, and gives the span. Only documents with a match are read again
to place spans in the original text.

A notice without allowed edits is one piece, its words between blanks, and every
place counts, overlapping ones too: these are the base phrases.

The scan is one pass without a shuffle. Memory: a slice of bounded bytes (or
one longer text), its words, and a bounded memory of windows seen before (passages
that many documents share are decided once a worker).

Defined results: null and empty texts have no words, no labels and score 0; repeated
rows give repeated results; extra columns are ignored; null ids stay null.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import arrow_slices, byte_texts

#: One edit a notice for every so many characters.
CHARS_PER_EDIT = 12
#: Windows remembered by a worker.
SEEN_WINDOWS = 50_000


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    errors: int = 0

    @property
    def base(self) -> bool:
        return self.errors == 0

    def text(self) -> str:
        return f" {self.words} " if self.base else self.words

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): ``errors + 1`` pieces of even length."""
        t = self.text()
        cuts = [len(t) * i // (self.errors + 1) for i in range(self.errors + 2)]
        return [(a, t[a:b]) for a, b in zip(cuts, cuts[1:])]


def fuzzy(label: str, words: str) -> Notice:
    return Notice(label, words, max(1, len(words) // CHARS_PER_EDIT))


#: The base phrases and their labels.
BASE = (Notice("mit", "under the mit license"), Notice("apache-2", "apache license version 2"), Notice("cc-by-nc", "cc by nc"))
#: Short notices of common licences, found with edits.
FUZZY = (
    fuzzy("mit", "under the mit license"),
    fuzzy("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    fuzzy("apache-2", "apache license version 2"),
    fuzzy("cc-by-nc", "creative commons attribution noncommercial"),
    fuzzy("cc-by-sa", "creative commons attribution sharealike"),
    fuzzy("cc0", "to the extent possible under law the author has waived all copyright"),
    fuzzy("bsd", "redistribution and use in source and binary forms with or without modification"),
    fuzzy("gpl", "under the terms of the gnu general public license"),
    fuzzy("lgpl", "gnu lesser general public license"),
    fuzzy("agpl", "gnu affero general public license"),
    fuzzy("mpl-2", "subject to the terms of the mozilla public license"),
    fuzzy("isc", "permission to use copy modify and or distribute this software for any purpose"),
    fuzzy("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: A-Z lowered; every ASCII byte that is no letter or digit becomes a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split_words(raw: bytes) -> list[bytes]:
    return raw.translate(_BYTES).split()


class Finder:
    """Seeds and window checks of a set of notices."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            for at, piece in notice.pieces():
                owners.setdefault(piece, []).append((n, at))
        for piece, who in owners.items():
            self.seeds.add_word(piece, (len(piece), who))
        self.seeds.make_automaton()
        self.checks = [regex.compile(f"(?b)(?:{regex.escape(x.text(), special_only=True)}){{e<={x.errors}}}") for x in notices]
        self.seen: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def check(self, n: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of the notice's best match in a window."""
        key = (n, window)
        if key not in self.seen:
            if len(self.seen) >= SEEN_WINDOWS:
                self.seen.clear()
            m = self.checks[n].search(window)
            self.seen[key] = None if m is None else (m.start(), m.end(), sum(m.fuzzy_counts))
        return self.seen[key]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in ``text``, words joined by blanks with one blank at either end.
        Matches of one notice do not overlap, but for those of base notices."""
        diagonals: dict[int, set[int]] = {}
        for end, (size, who) in self.seeds.iter(text):
            for n, at in who:
                diagonals.setdefault(n, set()).add(end + 1 - size - at)
        out = []
        for n, starts in diagonals.items():
            k, size = self.notices[n].errors, len(self.notices[n].text())
            found = set()
            starts, i = sorted(starts), 0
            while i < len(starts):
                j = bisect_right(starts, starts[i] + 2 * k)
                lo = max(0, starts[i] - k)
                hit = self.check(n, text[lo:starts[j - 1] + size + k])
                if hit is not None:
                    found.add((hit[2], lo + hit[0], lo + hit[1]))
                i = j
            if self.notices[n].base:
                out += [(n, s, e, c) for c, s, e in found]
                continue
            taken: list[tuple[int, int]] = []
            for c, s, e in sorted(found):  # fewest edits first
                i = bisect_right(taken, (s, e))
                if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
                    taken.insert(i, (s, e))
                    out.append((n, s, e, c))
        return sorted(out, key=lambda x: (x[1], x[0]))


def place(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the joined words (one blank before them) as spans of ``text``, in code points."""
    words = [m.span() for m in WORD.finditer(text)]
    joined, at = [], 1
    for s, e in words:
        joined.append(at)
        at += e - s + 1

    def back(x: int) -> tuple[int, int]:
        i = max(0, bisect_right(joined, x) - 1)
        return i, max(0, x - joined[i])

    out = []
    for s, e in spans:
        i, x = back(s)
        if i + 1 < len(words) and x >= words[i][1] - words[i][0]:
            i, x = i + 1, 0  # a match that begins with the blank between words
        j, y = back(e - 1)
        out.append((words[i][0] + x, min(words[j][0] + y + 1, words[j][1])))
    return out


COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])


def scan(docs: DataFrame, notices: tuple[Notice, ...] = BASE + FUZZY) -> DataFrame:
    """A row per document: ``n_words``; places of base notices (``n_base``, first and last start as a word number);
    ``base_labels`` and ``labels``; ``score`` = 1 - edits / length of the best match; ``spans``: label:start:end:edits
    of all matches in code points of the text, by start."""

    def one(finder: Finder, raw: bytes) -> tuple:
        words = split_words(raw)
        text = f" {b' '.join(words).decode('utf-8', 'replace')} "
        hits = finder.find(text)
        base = [s for n, s, _, _ in hits if notices[n].base]
        names = {notices[n].label for n, *_ in hits}
        based = {notices[n].label for n, *_ in hits if notices[n].base}
        score = max((1.0 - c / len(notices[n].words) for n, _, _, c in hits), default=0.0)
        spans = ""
        if hits:
            inner = [(s + 1, e - 1) if notices[n].base else (s, e) for n, s, e, _ in hits]
            at = place(raw.decode("utf-8", "replace"), inner)
            spans = ",".join(f"{notices[n].label}:{s}:{e}:{c}" for (n, _, _, c), (s, e) in zip(hits, at))
        number = [text.count(" ", 0, x) for x in (min(base), max(base))] if base else [None, None]
        return (len(words), len(base), *number, ",".join(sorted(based)), ",".join(sorted(names)), score, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices)
        for b in arrow_slices(batches):
            rows = [one(finder, raw) for raw in byte_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(COLUMNS)[1:]))], schema=COLUMNS)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
