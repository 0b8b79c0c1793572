"""Secret scan with a trigram inverted index.

Each rule is a regex. From its parsed form a Boolean trigram query is derived: a
literal run gives the AND of its trigrams, an alternation the OR of its
branches, a sequence the AND of its parts; parts that may match anything give no
condition. Inside a task, documents form blocks; a block gets an inverted index
(trigram -> sorted postings of its documents) over the trigrams the
rules ask for. Postings are intersected and united as the queries say, and only
candidate documents are verified with the regex. A rule whose query is empty
(no mandatory trigram) scans every document of the block.

Trigrams are those of the text's UTF-8 bytes with ASCII letters lower-cased, so
the index serves case-sensitive and case-insensitive rules alike: it can only
admit too many candidates, never too few. Rules must be ASCII-only patterns.

The scan is one pass without a shuffle: text never leaves the task that read
it. A block is bounded in bytes, so memory does not depend on the table.

Defined results: null text is empty; an empty text has no spans and the digest of
the empty string; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import arrow_slices, byte_texts

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # pragma: no cover  (older Python)
    import sre_constants as C
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """``keep`` sees a match and decides whether it counts."""
    kind: str
    pattern: str
    flags: int = re.ASCII
    keep: Callable[[re.Match], bool] | None = None

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)


#: The three base kinds, in their order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         re.ASCII | re.IGNORECASE, lambda m: len(m.group(2)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, lambda m: m.end() - m.start() >= 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, lambda m: m.end() - m.start() >= 24),
)
#: Kinds the index makes cheap to add: most documents are never verified for them.
ADDED_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{1,100}@"),
    Rule("bearer", r"(?:authorization|bearer)['\"]?[:\x20]\x20*(?:bearer\x20+)?[a-z0-9_.=-]{20,}", re.ASCII | re.IGNORECASE),
)

# A query is None (anything), a trigram (bytes), or ("and" | "or", frozenset of queries).
Query = object


def _both(kind: str, parts) -> Query:
    parts = set(parts)
    if kind == "and":
        parts.discard(None)
        if not parts:
            return None
    elif None in parts:
        return None
    flat = set()
    for p in parts:
        if isinstance(p, tuple) and p[0] == kind:
            flat |= p[1]
        else:
            flat.add(p)
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _run(lits: set[bytes]) -> Query:
    """OR over possible literal strings of the AND of each one's trigrams."""
    return _both("or", [_both("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in lits])


def trigram_query(pattern: str, flags: int = 0, most: int = 64) -> Query:
    """Boolean trigram query that every match's text satisfies (lower-cased bytes)."""

    def strings(op, arg) -> set[bytes] | None:
        """All lower-cased strings a small part can match, or None if unknown."""
        if op is C.LITERAL and arg < 128:
            return {chr(arg).lower().encode()}
        if op is C.IN and all(o is C.LITERAL and a < 128 for o, a in arg) and len(arg) <= 4:
            return {chr(a).lower().encode() for _, a in arg}
        if op is C.SUBPATTERN:
            return sequence_strings(arg[-1])
        if op is C.BRANCH:
            parts = [sequence_strings(p) for p in arg[1]]
            out = set().union(*parts) if None not in parts else None
            return out if out and len(out) <= most else None
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] != C.MAXREPEAT and arg[1] <= 3:
            one = sequence_strings(arg[2])
            if one is None:
                return None
            out, power = set(), {b""}
            for n in range(int(arg[1]) + 1):
                if n >= arg[0]:
                    out |= power
                power = {a + b for a in power for b in one}
                if len(power) > most:
                    return None
            return out
        return None

    def sequence_strings(seq) -> set[bytes] | None:
        out = {b""}
        for op, arg in seq:
            s = strings(op, arg)
            if s is None:
                return None
            out = {a + b for a in out for b in s}
            if len(out) > most:
                return None
        return out

    def need(seq) -> Query:
        parts, held = [], {b""}

        def close():
            nonlocal held
            parts.append(_run(held))
            held = {b""}

        for op, arg in seq:
            s = strings(op, arg)
            if s is not None and len(held) * len(s) <= most:
                held = {a + b for a in held for b in s}
                continue
            close()
            if s is not None:
                held = s
            elif op is C.SUBPATTERN:
                parts.append(need(arg[-1]))
            elif op is C.BRANCH:
                parts.append(_both("or", [need(p) for p in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                parts.append(need(arg[2]))
        close()
        return _both("and", parts)

    return need(parser.parse(pattern, flags))


def trigrams_of(q: Query) -> set[bytes]:
    if q is None:
        return set()
    return {q} if isinstance(q, bytes) else set().union(*(trigrams_of(p) for p in q[1]))


class TrigramIndex:
    """Postings of a block of documents for the wanted trigrams."""

    def __init__(self, wanted: set[bytes]):
        self.number = {t: i + 1 for i, t in enumerate(sorted(wanted))}
        self.code = np.zeros(1 << 24, dtype=np.uint8 if len(wanted) < 255 else np.uint16)
        for t, i in self.number.items():
            self.code[(t[0] << 16) | (t[1] << 8) | t[2]] = i
        self.n, self.postings = 0, {}

    def build(self, texts: list[bytes]) -> None:
        self.n, self.postings = len(texts), {}
        raw = np.frombuffer(b"\n\n".join(texts).lower(), dtype=np.uint8)
        if len(raw) < 3:
            return
        # rolling 24-bit code of each position, a few MB at a time
        starts = np.cumsum([0] + [len(t) + 2 for t in texts])
        at, num = [], []
        for lo in range(0, len(raw) - 2, 1 << 20):
            part = raw[lo:lo + (1 << 20) + 2].astype(np.uint32)
            hit = self.code[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            pos = np.flatnonzero(hit)
            at.append(pos + lo)
            num.append(hit[pos].astype(np.int64))
        pos, num = np.concatenate(at), np.concatenate(num)
        doc = np.searchsorted(starts, pos, side="right") - 1
        pairs = np.unique(num * self.n + doc)
        num, doc = pairs // self.n, pairs % self.n
        cut = np.searchsorted(num, np.arange(1, len(self.number) + 2))
        self.postings = {t: doc[cut[i - 1]:cut[i]] for t, i in self.number.items()}

    def candidates(self, q: Query) -> np.ndarray:
        """Documents of the block that satisfy the query, ascending."""
        if q is None:
            return np.arange(self.n)
        if isinstance(q, bytes):
            return self.postings.get(q, np.empty(0, np.int64))
        parts = sorted((self.candidates(p) for p in q[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out


def found_spans(text: str, rule: Rule, regex: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if rule.keep is None or rule.keep(m)]


def span_text(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """kind:start:end by start, then kind as listed (then end), comma-joined."""
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """``doc_id``, a count per base kind (``n_<kind>``), ``base_sha256``, ``spans`` and
    ``verified`` (how many rules were verified on the document)."""
    names = [f"n_{r.kind}" for r in rules[:base]]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_sha256", pa.string()), ("spans", pa.string()),
                        ("verified", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regexes = [r.regex() for r in rules]
        wanted = [trigram_query(r.pattern, r.flags) for r in rules]
        index = TrigramIndex(set().union(*map(trigrams_of, wanted)))
        for b in arrow_slices(batches):
            raw = byte_texts(b.column(1))
            index.build(raw)
            texts: dict[int, str] = {}
            spans: list[list[tuple[int, int, int]]] = [[] for _ in raw]
            verified = np.zeros(len(raw), np.int64)
            for k, (rule, regex, q) in enumerate(zip(rules, regexes, wanted)):
                for i in index.candidates(q).tolist():
                    if i not in texts:
                        texts[i] = raw[i].decode("utf-8", "replace")
                    verified[i] += 1
                    spans[i] += [(s, k, e) for s, e in found_spans(texts[i], rule, regex)]
            counts = [[sum(k == j for _, k, _ in s) for s in spans] for j in range(base)]
            digest = [hashlib.sha256(span_text([x for x in s if x[1] < base], rules).encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()),
                 pa.array([span_text(s, rules) for s in spans], pa.string()), pa.array(verified)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, ", ".join(["doc_id long", *(f"{n} long" for n in names), "base_sha256 string", "spans string", "verified long"]))
