"""Quality classifier: Bradley-Terry pairwise ranking.

Every document has a vector of text features: surface measures, and the shares of its words and of its character
trigrams in ``BUCKETS`` hash buckets each, so that faults of wording are learned as well. A preference pair is a document
labelled good over one labelled bad; its probability is the logistic function of
the difference of the two documents' scores, so a linear score w.x is learned by
logistic loss on feature differences (ridge, Newton steps). The accepting
threshold is the quantile of the training scores at the share of bad labels;
scores are squashed to 0..1 so that the threshold lies at ``cut``.

The fit uses all labelled rows (distinct id and label). Their feature rows are dealt by hash into chunks of some
``CHUNK_ROWS``, each written as one row; pairs are made within a chunk (``pairs_per_row`` a row). A Newton step is a pass over the chunks,
of which only sums reach the driver, and the threshold is the exact quantile of all training scores. (``sample_rows`` fits on a
sample of that many rows instead, chosen by the hash of the id, then cut by count, on the driver.) Scoring is one pass over whole texts without a
shuffle.

Defined results: null text is empty; an empty or one-word text has the features
of an empty one plus its length; unlabelled rows, rows with a null id and null labels
are not learned from; with no pair (one class missing) every score is ``NO_MODEL``;
repeated rows are scored alike; extra columns pass through untouched (``score`` refuses a score column whose name is taken:
name another).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessel.llm.common import arrow_slices, byte_texts, count_rows, stored
from tessel.operators.quantiles import order_statistics

CHUNK_ROWS = 20_000
#: Rows of each class that a chunk has about, at least, so that all its rows find a pair.
CHUNK_LEAST = 64
PAIRS_PER_ROW = 8
CUT = 0.3
NO_MODEL = 0.5
RIDGE = 1e-2
SEED = 17

#: Hash buckets of words, and as many of character trigrams.
BUCKETS = 64
#: A hashed feature counts a quarter of a surface one, so the ridge holds it down sixteen times as much.
HASHED_WEIGHT = 0.25
#: Pairs whose differences are held at a time while fitting.
PAIR_ROWS = 1 << 11

SURFACE = ("log_words", "tiny", "symbols", "symbols_high", "upper", "upper_high", "digits", "pipes", "word_len", "long_words",
            "repeats", "repeats_high", "neighbours", "same_lines", "lines_per_word", "end_marks")
N_FEATURES = len(SURFACE) + 2 * BUCKETS


def hashed(raw: bytes, words: list[bytes]) -> np.ndarray:
    """Shares of the words, then of the character trigrams (bytes, letters lower-cased), in each bucket."""
    out = np.zeros(2 * BUCKETS)
    if words:
        out[:BUCKETS] = np.bincount(np.fromiter((zlib.crc32(w.lower()) for w in words), np.int64, len(words)) % BUCKETS, minlength=BUCKETS) / len(words)
    low = raw.lower()
    for at in range(0, len(low) - 2, 1 << 20):
        b = np.frombuffer(low[at:at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        out[BUCKETS:] += np.bincount((code >> np.uint32(13)) % BUCKETS, minlength=BUCKETS)
    out[BUCKETS:] /= max(1, len(low) - 2)
    return out


def text_features(raw: bytes) -> np.ndarray:
    """Features of one whole text, each in a bounded range."""
    words = raw.split()
    return np.concatenate([surface(raw, words), hashed(raw, words)])


def surface(raw: bytes, words: list[bytes]) -> list[float]:
    n = len(words)
    if not n:
        return [0.0, 1.0] + [0.0] * (len(SURFACE) - 2)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, high = int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[128:].sum())
    digits, space = int(hist[48:58].sum()), int(hist[32] + hist[9:14].sum())
    letters = upper + lower + high
    size = max(1, len(raw) - space)
    symbols = max(0, size - letters - digits) / size
    up = upper / max(1, letters)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # distinct words against what a text of this length has at least by a slow growth law
    expected = max(1.0, 2.0 * n ** 0.55)
    repeats = max(0.0, 1.0 - len(set(words)) / min(float(n), expected))
    neighbours = sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
    mean = size / n
    return [math.log1p(n) / 10, math.exp(-n / 8), min(1.0, 4 * symbols), float(symbols > 0.15), up, float(up > 0.3), digits / size,
            min(1.0, 8 * words.count(b"|") / n), min(2.0, mean / 10), sum(len(w) > 30 for w in words) / n, repeats, float(repeats > 0.5),
            neighbours, 1.0 - len(set(lines)) / max(1, len(lines)), min(1.0, len(lines) / n),
            min(1.0, 10 * (int(hist[46]) + int(hist[33]) + int(hist[63])) / n)]


def preference_pairs(good: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(good row, bad row) numbers: every row takes part; permutations repeated and paired at random."""
    g, b = np.flatnonzero(good), np.flatnonzero(~good)
    rng = np.random.default_rng(seed)
    m = pairs_per_row * (len(g) + len(b))
    left = np.concatenate([rng.permutation(g) for _ in range(-(-m // len(g)))])[:m]
    right = np.concatenate([rng.permutation(b) for _ in range(-(-m // len(b)))])[:m]
    return left, rng.permutation(right)


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w in double precision, some rows of a single-precision matrix at a time."""
    return np.concatenate([x[at:at + PAIR_ROWS].astype(np.float64) @ w for at in range(0, len(x), PAIR_ROWS)] or [np.empty(0)])


def bradley_terry(x: np.ndarray, good: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, ridge: float = RIDGE,
                  seed: int = SEED, steps: int = 30) -> np.ndarray | None:
    """Weights w that maximise sum log sigmoid(w.(x_good - x_bad)) - ridge; None without pairs."""
    if good.all() or not good.any():
        return None
    left, right = preference_pairs(good, pairs_per_row, seed)
    m, w = len(left), np.zeros(x.shape[1])
    parts = [slice(at, at + PAIR_ROWS) for at in range(0, m, PAIR_ROWS)]

    def loss(v: np.ndarray) -> float:
        s = product(x, v)
        return float(np.logaddexp(0, s[right] - s[left]).mean() + ridge * v @ v / 2)

    now = loss(w)
    for _ in range(steps):
        grad, hess = ridge * w, ridge * np.eye(len(w))
        for part in parts:
            d = (x[left[part]] - x[right[part]]).astype(np.float64)
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
            grad -= d.T @ p / m
            hess += (d * (p * (1 - p))[:, None]).T @ d / m
        step = np.linalg.solve(hess, grad)
        rate = 1.0
        while (new := loss(w - rate * step)) > now and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if now - new < 1e-10:
            break
        now = new
    return w


class QualityModel:
    """Score w.x, squashed around the quantile threshold."""

    def __init__(self, x: np.ndarray, good: np.ndarray, cut: float = CUT, reject_share: float | None = None):
        self.mean, self.scale = (x.mean(0, np.float64), np.maximum(x.std(0, np.float64), 1e-6)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
        self.scale[len(SURFACE):] /= HASHED_WEIGHT
        z = x - self.mean.astype(x.dtype)
        z /= self.scale.astype(x.dtype)
        self.w = bradley_terry(z, good)
        self.cut, self.threshold, self.slope = cut, 0.0, 1.0
        if self.w is not None:
            s = np.sort(product(z, self.w))
            at = min(len(s) - 1, max(1, round(len(s) * (float((~good).mean()) if reject_share is None else reject_share))))
            self.threshold = float(s[at - 1] + s[at]) / 2
            self.slope = 4.0 / max(1e-6, float(s.std()))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), NO_MODEL)
        z = self.slope * (self.raw(x) - self.threshold) + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None, cut: float = CUT) -> QualityModel:
    """Learn from ``labels`` (doc_id, quality) joined with ``docs`` (doc_id, text)."""
    lab = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality").cast("int") == 1).alias("good")).dropna().distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_slices(batches):
            x = pa.array([text_features(t).astype("<f4").tobytes() for t in byte_texts(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["doc_id", "x"])

    if sample_rows is None:  # features are joined with labels: texts are not shuffled
        found = stored(texts.mapInArrow(run, "doc_id long, x binary").join(lab, "doc_id"), "quality-features")
        return fit_chunks(chunked(found), cut)
    n = count_rows(lab)
    share = 1_000_000 if n <= sample_rows else sample_rows * 1_000_000 // n
    # at most about sample_rows ids, two rows each: a proven bound for the broadcast
    sample = F.broadcast(lab.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < share))
    found = texts.join(sample, "doc_id", "left_semi").mapInArrow(run, "doc_id long, x binary").join(sample, "doc_id")
    # the cut by count holds even if one document comes many times
    rows: pd.DataFrame = found.orderBy(F.xxhash64("doc_id", "good", "x"), "doc_id", "good", "x").limit(sample_rows).toPandas()
    rows = rows.sort_values(["doc_id", "good", "x"])
    good = rows["good"].to_numpy(bool)
    x = np.frombuffer(b"".join(rows.pop("x")), "<f4").reshape(len(good), N_FEATURES)
    return QualityModel(x, good, cut)


def chunked(found: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``chunk, good, x``: the rows of ``found`` (``doc_id, good, x``) in chunks, a row each, labels and features as bytes."""
    n = {r["good"]: r["n"] for r in found.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = max(1, min(-(-sum(n.values()) // chunk_rows), min(n.get(True, 0), n.get(False, 0)) // CHUNK_LEAST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, good, x = None, [], []

        def done():
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bytes(good)], pa.binary()), pa.array([b"".join(x)], pa.binary())],
                                                 names=["chunk", "good", "x"])

        for b in batches:
            for c, g, v in zip(*(b.column(i).to_pylist() for i in range(3))):
                if c != now:
                    yield from done()
                    now, good, x = c, [], []
                good.append(g)
                x.append(v)
        yield from done()

    # equal rows are numbered, so that copies of one row are dealt as others are
    copies = found.groupBy("doc_id", "good", "x").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "good", "x", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    at = F.pmod(F.xxhash64("doc_id", "good", "x", "k", F.lit(SEED)), F.lit(chunks)).cast("int")
    dealt = copies.select(at.alias("chunk"), "doc_id", "good", "x").repartition(chunks, "chunk").sortWithinPartitions("chunk", "doc_id", "good", "x")
    return stored(dealt.select("chunk", "good", "x").mapInArrow(run, "chunk int, good binary, x binary"), "quality-chunks")


def over(chunks: DataFrame, count: int, sums) -> list[np.ndarray]:
    """The sum over all chunks of each of the ``count`` arrays that ``sums(x, good, chunk)`` returns, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for c, g, v in zip(*b.columns):
                good = np.frombuffer(g.as_buffer(), np.uint8).astype(bool)
                got = sums(np.frombuffer(v.as_buffer(), "<f4").reshape(len(good), -1), good, c.as_py())
                total = got if total is None else [a + x for a, x in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, np.float64).tobytes()], pa.binary()) for x in total], names=[f"s{i}" for i in range(len(total))])

    rows = chunks.mapInArrow(run, ", ".join(f"s{i} binary" for i in range(count))).collect()  # a row a task
    return [sum(np.frombuffer(r[i]) for r in rows) for i in range(count)] if rows else []


def fit_chunks(chunks: DataFrame, cut: float = CUT) -> QualityModel:
    """The model of :class:`QualityModel` over the rows of all ``chunks``, pairs within each; by passes over them."""
    model = QualityModel(np.empty((0, N_FEATURES), "<f4"), np.empty(0, bool), cut)
    first = over(chunks, 2, lambda x, good, chunk: [np.array([len(good), good.sum()]), x.sum(0, np.float64)])
    if not first or not 0 < first[0][1] < first[0][0]:
        return model
    n, n_good = (int(v) for v in first[0])
    mean = first[1] / n
    squares, = over(chunks, 1, lambda x, good, chunk: [((x - mean) ** 2).sum(0)])
    model.mean, model.scale = mean, np.maximum(np.sqrt(squares / n), 1e-6)
    model.scale[len(SURFACE):] /= HASHED_WEIGHT
    mean4, scale4 = mean.astype("<f4"), model.scale.astype("<f4")

    def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian."""
        def part(x, good, chunk):
            k = len(v)
            grad, hess, m, lost = np.zeros(k), np.zeros((k, k)), 0, 0.0
            if good.any() and not good.all():
                z = (x - mean4) / scale4
                left, right = preference_pairs(good, seed=SEED + chunk)
                for lo in range(0, len(left), PAIR_ROWS):
                    d = (z[left[lo:lo + PAIR_ROWS]] - z[right[lo:lo + PAIR_ROWS]]).astype(np.float64)
                    s = np.clip(d @ v, -500, 500)
                    p = 1 / (1 + np.exp(s))
                    grad -= d.T @ p
                    hess += (d * (p * (1 - p))[:, None]).T @ d
                    lost += float(np.logaddexp(0, -s).sum())
                m = len(left)
            return [np.array([m, lost]), grad, hess.ravel()]

        (m, lost), grad, hess = over(chunks, 3, part)
        k = len(v)
        return lost / m + RIDGE * v @ v / 2, grad / m + RIDGE * v, hess.reshape(k, k) / m + RIDGE * np.eye(k)

    w = np.zeros(N_FEATURES)
    now, grad, hess = at(w)
    for _ in range(30):
        step, rate = np.linalg.solve(hess, grad), 1.0
        new, grad, hess = at(w - step)
        while new > now and rate > 1e-6:
            rate /= 2
            new, grad, hess = at(w - rate * step)
        w = w - rate * step
        if now - new < 1e-10:
            break
        now = new
    model.w = w

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v in b.column(0):
                z = (np.frombuffer(v.as_buffer(), "<f4").reshape(-1, len(w)) - mean4) / scale4
                yield pa.RecordBatch.from_arrays([pa.array(product(z, w))], names=["v"])

    s = stored(chunks.select("x").mapInArrow(scores, "v double"), "quality-scores")
    k = min(n - 1, max(1, round(n * (1 - n_good / n))))
    known = order_statistics(s, [k - 1, k])
    model.threshold = (known[k - 1] + known[k]) / 2
    model.slope = 4.0 / max(1e-6, float(s.agg(F.stddev_pop("v")).first()[0]))
    return model


def score(docs: DataFrame, model: QualityModel, score_col: str = "quality_score") -> DataFrame:
    """``docs`` with ``score_col`` (double, 0 to 1) appended; other columns as they are."""
    if score_col in docs.columns:
        raise ValueError(f"docs already has a column {score_col}; name another with score_col")
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_slices(batches):
            x = np.array([text_features(t) for t in byte_texts(b.column(text_at))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
