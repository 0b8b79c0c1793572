"""Language identification of mixed-language text.

Words are runs of letters with their combining marks. A word's script (by Unicode ranges) narrows the
candidate languages to those the training texts write in that script. Among
the candidates a word is scored by its letter trigrams (smoothed log
probabilities per language, hashed into a fixed number of buckets), normalised
over the languages and bounded. Viterbi over the word scores, with a penalty for every switch of
language, labels the words; runs of one label are the spans.

Model: one array of ``BUCKETS`` floats and one row of script shares per language,
whatever the corpus; it is fitted on a bounded sample (``sample_rows``, by the
hash of the id). Prediction is one pass over whole texts without a shuffle:
Viterbi runs for all documents of a slice at once, step t handling the t-th
word of every text that long.

Defined results: a text that is null, empty or without letters has no span and
language ``und``, score 0; without any training text so has every text; rows with a null language are
not learned from; repeated rows are labelled alike; ties go to the alphabetically first language;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import arrow_slices, count_rows

SAMPLE_ROWS = 40_000
BUCKETS = 1 << 15
SWITCH, BOUND, OUT_OF_SCRIPT = 6.0, 4.0, 8.0
CACHE_WORDS = 400_000
SEED = 23
#: A word: letters with their combining marks.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")

#: First code points of script ranges (Unicode blocks), in order; what lies between is "other".
SCRIPTS = (
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"),
    (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x323B0, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([0, *(at for at, _ in SCRIPTS)])
_NUMBER = np.array([SCRIPT_NAMES.index("other"), *(SCRIPT_NAMES.index(n) for _, n in SCRIPTS)])


def word_arrays(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words (with edge marks), where each word's begin,
    and each word's script (that of its first letter)."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    h = (code[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (code[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(49)).astype(np.int64)  # 15 bits
    inside = np.ones(len(code), bool)  # a trigram must not cross two words
    inside[first + size - 1] = False
    inside[first + size - 2] = False
    keep = np.flatnonzero(inside[:-2])
    starts = np.searchsorted(keep, first)
    script = _NUMBER[np.searchsorted(_STARTS, code[first + 1].astype(np.int64), side="right") - 1]
    return bucket[keep], starts, script


class LanguageModel:
    """``langs``, log probabilities (buckets x langs), and which scripts each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, least_share: float = 0.02):
        self.langs = langs
        if langs:
            total = counts.sum(1, keepdims=True)
            self.logp = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32)
            self.uses = scripts >= least_share * np.maximum(1, scripts.sum(1, keepdims=True))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """One bounded score per word and language; all zero where no language has the script."""
        bucket, starts, script = word_arrays([w.lower() for w in words])
        s = np.add.reduceat(self.logp[bucket], starts, axis=0)
        s -= s.max(1, keepdims=True)
        s = np.maximum(s, -BOUND)
        can = self.uses[:, script].T
        s = np.where(can, s, -OUT_OF_SCRIPT)
        s[~can.any(1)] = 0.0
        return (s - s.max(1, keepdims=True)).astype(np.float32)


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word. Document d owns rows starts[d] .. starts[d]+lengths[d];
    step t advances all documents that have a t-th word."""
    order = np.argsort(-lengths, kind="stable")
    st, ln = starts[order], lengths[order]
    label = np.zeros(len(scores), np.int16)
    if not len(scores):
        return label
    steps = int(ln[0])
    alive = np.searchsorted(-ln, -np.arange(1, steps + 1), side="right")  # documents with more than t words
    came = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    v = scores[st[:alive[0]]]
    final = np.zeros(len(ln), np.int64)
    for t in range(1, steps + 1):
        a = int(alive[t]) if t < steps else 0
        if a < len(v):  # these documents end here
            final[a:len(v)] = v[a:].argmax(1)
            v = v[:a]
        if not a:
            break
        best = v.argmax(1)
        jump = v[np.arange(a), best] - np.float32(switch)
        stay = v >= jump[:, None]
        rows = st[:a] + t
        came[rows] = np.where(stay, own, best[:, None].astype(np.int16))
        v = np.where(stay, v, jump[:, None]) + scores[rows]
    now = final.copy()
    for t in range(steps - 1, -1, -1):
        a = int(alive[t])
        rows = st[:a] + t
        label[rows] = now[:a]
        if t:
            now[:a] = came[rows, now[:a]]
    return label


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang); null languages and texts are left out."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = count_rows(d)
    share = 1_000_000 if n <= sample_rows else sample_rows * 1_000_000 // n
    d = d.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_slices(batches, max_bytes=8 << 20):
            by: dict[str, Counter] = {}
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                by.setdefault(lang, Counter()).update(WORD.findall(text))
            for lang, words in by.items():
                if not words:
                    continue
                keys = list(words)
                weight = np.fromiter(words.values(), np.int64, len(keys))
                bucket, starts, script = word_arrays([w.lower() for w in keys])
                per = np.repeat(weight, np.diff(np.append(starts, len(bucket))))
                c = np.bincount(bucket, per, BUCKETS).astype(np.int64)
                s = np.bincount(script, weight, len(SCRIPT_NAMES)).astype(np.int64)
                at = np.flatnonzero(c)
                at_s = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(at) + len(at_s)), pa.string()), pa.array(np.concatenate([at, -1 - at_s])),
                     pa.array(np.concatenate([c[at], s[at_s]]))], names=["lang", "key", "n"])

    rows: pd.DataFrame = (d.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
                          .toPandas())  # at most BUCKETS + scripts rows per language
    langs = sorted(rows["lang"].unique().tolist())
    counts, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(SCRIPT_NAMES)))
    for i, lang in enumerate(langs):
        r = rows[rows["lang"] == lang]
        k, v = r["key"].to_numpy(), r["n"].to_numpy()
        counts[i, k[k >= 0]] = v[k >= 0]
        scripts[i, -1 - k[k < 0]] = v[k < 0]
    return LanguageModel(langs, counts, scripts)


SPAN = "array<struct<start:int,end:int,lang:string,letters:int,trust:double>>"


def language_spans(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """``doc_id, spans``: runs of one language as code-point ranges (from the first
    word's start to the last word's end), their letters, and ``trust``: the mean
    over words of the language's share among the word's scored languages."""
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("letters", pa.int32()), ("trust", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        table = np.empty((0, len(model.langs)), np.float32)
        for b in arrow_slices(batches):
            texts = b.column(1).to_pylist()
            found = [WORD.findall(t) if t else [] for t in texts] if model.langs else [[] for _ in texts]
            words = set().union(*found) if found else set()
            new = [w for w in words if w not in number]
            if len(number) + len(new) > CACHE_WORDS:
                number, table, new = {}, table[:0], list(words)
            for at in range(0, len(new), 20_000):
                part = new[at:at + 20_000]
                number.update(zip(part, range(len(table), len(table) + len(part))))
                table = np.concatenate([table, model.word_scores(part)])
            lengths = np.array([len(x) for x in found], np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            ids = np.fromiter((number[w] for x in found for w in x), np.int64, int(lengths.sum()))
            scores = table[ids]
            label = viterbi(scores, starts, lengths, switch)
            trust = np.exp(scores[np.arange(len(ids)), label]) / np.maximum(1e-9, np.exp(scores).sum(1)) if len(ids) else np.empty(0)
            out = []
            for text, ws, s, n in zip(texts, found, starts.tolist(), lengths.tolist()):
                if not n:
                    out.append([])
                    continue
                lab = label[s:s + n]
                cut = np.flatnonzero(np.diff(lab)) + 1
                first = [0, *cut.tolist()]
                after = [*cut.tolist(), n]
                if len(first) == 1:
                    place = [(WORD.search(text).start(), text.rindex(ws[-1]) + len(ws[-1]))]
                else:
                    all_ = [m.span() for m in WORD.finditer(text)]
                    place = [(all_[i][0], all_[j - 1][1]) for i, j in zip(first, after)]
                size = np.fromiter(map(len, ws), np.int64, n)
                out.append([{"start": p, "end": q, "lang": model.langs[lab[i]], "letters": int(size[i:j].sum()),
                             "trust": float(trust[s + i:s + j].mean())} for (p, q), i, j in zip(place, first, after)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, span_type)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, spans {SPAN}")


def main_language(spans: DataFrame) -> DataFrame:
    """``lang_pred`` (most letters; ties to the first name) and ``score`` = its share
    of the letters times its spans' mean trust; ``und`` and 0 without spans."""
    names = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["lang"])))
    by = F.transform(names, lambda n: F.struct(
        F.aggregate(F.filter("spans", lambda s: s["lang"] == n), F.lit(0), lambda a, s: a + s["letters"]).alias("letters"),
        F.aggregate(F.filter("spans", lambda s: s["lang"] == n), F.lit(0.0), lambda a, s: a + s["letters"] * s["trust"]).alias("sure"),
        n.alias("lang")))
    # most letters, then the first name: names are in order, so the first of the largest
    most = F.array_max(F.transform("by", lambda x: x["letters"]))
    total = F.aggregate("by", F.lit(0), lambda a, x: a + x["letters"])
    d = spans.withColumn("by", by)
    some = F.size("by") > 0
    d = d.withColumn("most", most)
    d = d.withColumn("best", F.get(F.filter("by", lambda x: x["letters"] == F.col("most")), F.lit(0))).withColumn("total", F.when(some, total))
    return (d.withColumn("lang_pred", F.coalesce(F.col("best.lang"), F.lit("und")))
            .withColumn("score", F.coalesce(F.col("best.sure") / F.col("total"), F.lit(0.0))).drop("by", "most", "best", "total"))

