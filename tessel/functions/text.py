"""Scalar text functions as Spark Column expressions.

All of these are built-in ``pyspark.sql.functions`` compositions, so they run
inside whole-stage codegen; only :func:`norm_key` needs Unicode NFKD, which
Spark has no built-in for, and uses a small Arrow-batched pandas UDF.

Python's ``str.split()`` / ``strip()`` are Unicode-aware; Java regex ``\\s``
is ASCII unless the ``(?U)`` flag is given, so every whitespace pattern here
carries ``(?U)``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

__all__ = [
    "norm_label", "norm_key", "norm_key_ws", "collapse_ws", "dedup_text_key",
    "norm_text", "token_count", "word_tokens", "word_ngrams", "shingles",
    "py_strip", "norm_title", "dup_suffix", "url_domain", "ws_tokens", "shingles_of_tokens",
]

# The patterns below (white space, label, key and text normalisers, tokenizers) are
# the specification of the normalised forms.
WS = r"(?U)\s+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: Unicode white space off both ends."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def collapse_ws(col) -> Column:
    """``" ".join(s.split())``: runs of Unicode whitespace -> one space, trimmed."""
    return F.trim(F.regexp_replace(_c(col), WS, " "))


def norm_label(col) -> Column:
    """Label-map key normaliser: lower, whitespace/slash/backslash runs -> ``_``,
    other non ``[0-9a-zA-Z_]`` runs -> ``_``, collapse ``_``, strip ``_``."""
    s = F.lower(_c(col))
    s = F.regexp_replace(s, r"(?U)[\s/\\]+", "_")
    s = F.regexp_replace(s, r"[^0-9a-zA-Z_]+", "_")
    s = F.regexp_replace(s, r"_+", "_")
    return F.regexp_replace(s, r"^_|_$", "")


@F.pandas_udf(StringType())
def _nfkd_strip_marks(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        d = unicodedata.normalize("NFKD", x)
        return "".join(ch for ch in d if not unicodedata.combining(ch))
    return s.map(one)


# Deterministic in fact; flagged otherwise so that a filter on the key does not run it twice.
_nfkd_strip_marks = _nfkd_strip_marks.asNondeterministic()


def norm_key(col) -> Column:
    """Actor key normaliser: lower, NFKD with combining marks removed,
    non ``[a-z0-9]`` runs -> ``_``, strip ``_``."""
    s = _nfkd_strip_marks(py_strip(F.lower(F.coalesce(_c(col), F.lit("")))))
    s = F.regexp_replace(s, r"[^a-z0-9]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def norm_key_ws(col) -> Column:
    """Label-derivation key: strip, lower, space/tab/newline -> ``_``,
    collapse ``_`` runs, strip ``_`` (keeps ``-`` and accents)."""
    s = F.lower(F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", ""))
    s = F.regexp_replace(s, r"[ \t\n]", "_")
    s = F.regexp_replace(s, r"_{2,}", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def dedup_text_key(col) -> Column:
    """md5 of the text-dedup key ``" ".join(t.split()).lower()``; only the
    32-char digest ever travels through a shuffle, never the text."""
    return F.md5(F.lower(collapse_ws(col)))


def norm_text(col) -> Column:
    """Corpus-stats text normaliser: NBSP -> space, ``"\\t _blank"`` -> space,
    drop ZWSP, then collapse whitespace."""
    s = F.coalesce(_c(col), F.lit(""))
    s = F.regexp_replace(s, "\u00a0", " ")
    s = F.regexp_replace(s, "\t _blank", " ")
    s = F.regexp_replace(s, "\u200b", "")
    return collapse_ws(s)


def token_count(col, tokenizer: str = "split") -> Column:
    """Token counts for the three tokenizers of the prepare stage.

    * ``split`` / ``whitespace``: Python ``len(t.split())``
    * ``simple``: newline -> space, split on single spaces, non-empty pieces
    * ``regex``: word runs or single punctuation marks
    """
    name = (tokenizer or "split").strip().lower()
    t = _c(col)
    if name == "simple":
        parts = F.split(F.translate(t, "\n", " "), " ")
        return F.size(F.filter(parts, lambda x: x != ""))
    if name == "regex":
        return F.size(F.regexp_extract_all(t, F.lit(r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), 0))
    if name in ("split", "whitespace"):
        return F.size(F.filter(F.split(t, WS), lambda x: x != ""))
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


# TF-IDF word pattern: lower-cased runs of >= 2 letters/digits/underscore.
WORD_RE = r"[\p{L}\p{N}_]{2,}"


def word_tokens(col) -> Column:
    """Lower-cased word tokens of length >= 2 (the vectoriser's default pattern)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_RE), 0)


def _ngrams(tok: Column, n: int) -> Column:
    """Space-joined n-grams of an array: ``zip_with`` over shifted slices, so
    the lambda sees only its own arguments (a lambda that reads the outer
    array would re-evaluate it per element, quadratic in document length)."""
    m = F.size(tok) - (n - 1)
    out = F.slice(tok, 1, F.greatest(m, F.lit(1)))
    for j in range(1, n):
        out = F.zip_with(out, F.slice(tok, j + 1, F.greatest(m, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tok) >= n, out).otherwise(F.array().cast("array<string>"))


def word_ngrams(tokens, n_max: int = 2) -> Column:
    """Unigrams followed by space-joined n-grams up to ``n_max``."""
    tok = _c(tokens)
    out = tok
    for n in range(2, n_max + 1):
        out = F.concat(out, _ngrams(tok, n))
    return out


def ws_tokens(col) -> Column:
    """Python ``str.split()`` tokens."""
    return F.filter(F.split(_c(col), WS), lambda x: x != "")


def shingles(col, k: int = 3) -> Column:
    """Every ``k`` consecutive whitespace tokens joined by a space; texts with
    fewer than ``k`` tokens yield an empty array. For large tables prefer
    projecting :func:`ws_tokens` first and calling :func:`shingles_of_tokens`:
    expressions with lambdas run interpreted, without common-subexpression
    elimination, so an inline token expression is re-evaluated per use."""
    return _ngrams(ws_tokens(col), k)


def shingles_of_tokens(tokens, k: int = 3) -> Column:
    return _ngrams(_c(tokens), k)


def norm_title(col) -> Column:
    """Title key: lower, strip, collapse whitespace."""
    return F.lower(collapse_ws(F.coalesce(_c(col), F.lit(""))))


def dup_suffix(id_col, k) -> Column:
    """Id of the k-th duplicate row: ``<id>#dup<k>``."""
    return F.concat(_c(id_col).cast("string"), F.lit("#dup"), _c(k).cast("string"))


def url_domain(col) -> Column:
    """Host of a URL, lower-cased, without a leading ``www.``."""
    host = F.lower(F.regexp_extract(_c(col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")
