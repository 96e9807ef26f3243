"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every text becomes a short vector of statistics. Random Fourier features of the standardised vector approximate a Gaussian
kernel; each partition sums its part of the normal equations over all labelled training rows, so that only one matrix of fixed
size travels; the ridge scores are then calibrated by isotonic regression over counts in fixed bins. Labels are learnt only
from rows of the training folds; the held-out fold is never looked at. Neither labels, lang, source nor doc_id enter a score.

Defined results: null counts as an empty text and is scored. Rows are scored one by one, so repeated rows score alike. If a
doc_id has several labels each counts. Without labels of both kinds every score is the share of label 1 (0.5 without any).
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fold_of, map_batches, materialise, texts_of

FOLDS, HELD_OUT = 3, 1
FEATURES = 192
WIDTH = 0.25
PARTS = 5  # a row is calibrated by weights learnt from the other parts
RIDGE = 1e-3
BINS = 400
SEED = 11
NAMES = [
    "words", "chars_per_word", "symbols_per_word", "duplicate_lines", "repeated_windows", "upper", "digits", "punctuation",
    "words_per_line", "distinct_words", "top_word", "adjacent_equal", "bars", "exclamations", "non_ascii", "longest_word",
]

_SYMBOLS, _PUNCTUATION = b"#*$%&|<>", b".,;:!?'\"()-"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str) -> list[float]:
    """The statistics of NAMES for a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda some: int(counts[list(some)].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = len(words) - 2
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        math.log1p(len(words)),
        math.log1p(len(b"".join(words)) / n),
        math.log1p(8 * of(_SYMBOLS) / n),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / windows if windows > 0 else 0.0,
        of(_UPPER) / size,
        of(_DIGITS) / size,
        of(_PUNCTUATION) / n,
        math.log1p(len(words) / max(1, len(lines))),
        math.log(len(distinct) + 1) / math.log(n + 1),
        max(distinct.values(), default=0) / n,
        same / n,
        math.log1p(8 * int(counts[124]) / n),
        math.log1p(8 * int(counts[33]) / n),
        float(counts[128:].sum()) / size,
        math.log1p(max(map(len, words), default=0)),
    ]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and `stats`, the statistics of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Model:
    """What scoring needs; a few thousand numbers, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # calibrated value per bin of the raw score
    constant: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of the standardised statistics, and a bias."""
        rng = np.random.default_rng(SEED)
        w, b = rng.normal(0, WIDTH, (len(NAMES), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(x @ w + b) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return self.steps[bins_of(self.raw(stats))]


def bins_of(raw: np.ndarray) -> np.ndarray:
    """Raw scores aim at 0 and 1; bins cover -0.5 to 1.5, the outer ones all beyond."""
    return np.clip(((raw + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


#: Partial sums that reach the driver.
_LEAVES = 8


def summed(df: DataFrame, fn, shape: tuple[int, int]) -> np.ndarray:
    """Element-wise sum over all partitions of the matrix that `fn` makes of each batch: one partial sum a partition, added up in a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += fn(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total += np.frombuffer(v).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    leaves = map_batches(map_batches(df, partial, "v binary").repartition(_LEAVES), added, "v binary").collect()
    return np.sum([np.frombuffer(r.v).reshape(shape) for r in leaves], axis=0)


def isotonic(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing means of bins by pooling adjacent violators, smoothed by half a row of either label at each end."""
    blocks: list[list[float]] = []
    for i in range(len(n)):
        blocks.append([float(ones[i]), float(n[i]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            o, c, w = blocks.pop()
            blocks[-1] = [blocks[-1][0] + o, blocks[-1][1] + c, blocks[-1][2] + w]
    prior = (ones.sum() + 0.5) / (n.sum() + 1.0)
    return np.concatenate([np.full(int(w), (o + prior) / (c + 1.0)) for o, c, w in blocks])


def fit(described: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from the labelled rows outside the held-out fold, all of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0))
    known = known.where(fold_of("doc_id", FOLDS) != HELD_OUT)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    train = materialise(described.join(known, "doc_id").select(part, "stats", "y"), "quality-train")
    size = len(NAMES)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _matrix(batch.column("stats")), batch.column("y").to_numpy()
        return np.vstack([np.r_[x.sum(0), len(x)], np.r_[(x * x).sum(0), y.sum()]])

    m = summed(train, moments, (2, size + 1))
    n, ones = m[0, -1], m[1, -1]
    if not n or not 0 < ones < n:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), ones / n if n else 0.5)
    mean = m[0, :-1] / n
    scale = np.sqrt(np.maximum(m[1, :-1] / n - mean**2, 1e-6))
    model = Model(mean, scale, np.zeros(0), np.zeros(0))

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y, at = model.features(_matrix(batch.column("stats"))), batch.column("y").to_numpy(), batch.column("part").to_numpy()
        blocks = [z[at == k].T @ np.hstack([z[at == k], y[at == k, None], np.ones(((at == k).sum(), 1))]) for k in range(PARTS)]
        return np.vstack(blocks)

    a = summed(train, normal, (PARTS * (FEATURES + 1), FEATURES + 3)).reshape(PARTS, FEATURES + 1, FEATURES + 3)
    model.weights = ridge(a.sum(0))
    without = [ridge(a.sum(0) - a[k]) for k in range(PARTS)]

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        z, y, at = model.features(_matrix(batch.column("stats"))), batch.column("y").to_numpy(), batch.column("part").to_numpy()
        bins = bins_of((z * np.array(without)[at]).sum(1))
        return np.vstack([np.bincount(bins, minlength=BINS), np.bincount(bins, weights=y, minlength=BINS)])

    c = summed(train, counts, (2, BINS))
    model.steps = isotonic(c[1], c[0])
    return model


def ridge(sums: np.ndarray) -> np.ndarray:
    """Weights of the normal equations; sums: z'z, z'y and z'1, whose last cell is the number of rows, as the last feature is 1."""
    gram, n = sums[:, :-2], sums[-1, -1]
    return np.linalg.solve(gram + RIDGE * max(n, 1.0) / FEATURES * np.eye(len(gram)), sums[:, -2])


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model learnt from the labelled ones outside the held-out fold."""
    described = materialise(describe(docs), "quality-stats")
    model = fit(described, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = np.clip(model.score(_matrix(batch.column("stats"))), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = map_batches(described, score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
