"""Hard negatives by distributed radix selection.

A window is an anchor, one of its positives, and the scores from 80% of the positive's up to the positive's. Of the rows of other labels
in it, the first k by falling score (ties by smaller id) are wanted. No window is ever gathered or sorted: tasks meet their rows with the
anchors' matrix in blocks and count, for each window, how many rows fall into each bucket of a range of scores; the sums tell the bucket
of the k-th row. Its range is cut again, digit by digit, until what lies up to the k-th is small; if many rows tie at its score, their
ids are cut in the same way. Then one pass gathers only rows up to there.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows meet anchors of the
same number of components only. Repeated rows are rows of their own as candidates; a repeated anchor counts once. An anchor of several
different rows has windows for each. Extra columns are ignored; an empty table, and a table without anchors, give an empty result.
Components and scores beyond 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import map_batches, materialise

POSITIVES = NEGATIVES = 5
ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
LEAST, MOST = 80, 100  # of a positive's score, in hundredths
SCALE = 256
#: Bits of a digit; rows up to the k-th that are few enough to be gathered; bytes of anchors, and windows, of a pass (histograms of a task: 8 MB).
DIGIT, FEW, PASS_BYTES, PASS_WINDOWS = 6, 64, 16 << 20, 16_384
_EXACT = 1 << 53
_BLOCK = 512


def rows_of(table: DataFrame) -> DataFrame:
    """id, label (moved by one where the id is divisible by 7) and v of rows without nulls."""
    each = table.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    moved = F.when(F.col("id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return each.select("id", moved.alias("label"), "v")


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and whole-number vectors of the rows that take part, a matrix for each number of components."""
    lists = batch.column("v")
    sizes, ids, labels = pc.list_value_length(lists).to_numpy(), batch.column("id").to_numpy(), batch.column("label").to_numpy()
    flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        v = flat[starts[rows, None] + np.arange(dim)[None, :]]
        fine = np.isfinite(v).all(1)
        v = np.floor(v[fine] * SCALE)
        if v.size and np.abs(v).max() >= 2.0**63:
            raise ArithmeticError("a component does not fit in 64 bits")
        yield ids[rows[fine]], labels[rows[fine]], v.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floats where all sums are exact in them, else by integers, which must fit in 64 bits."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        wide = a.astype(object) @ b.T.astype(object)
        if wide.size and max(abs(x) for x in wide.flat) >= 1 << 63:
            raise ArithmeticError("a score does not fit in 64 bits")
        return wide.astype(np.int64)
    return a @ b.T


@dataclass
class Anchors:
    """The anchors of a pass: number, id, label and, for each number of components, the numbers and the matrix."""

    ids: np.ndarray
    labels: np.ndarray
    matrices: dict[int, tuple[np.ndarray, np.ndarray]]

    def blocks(self, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        numbers, matrix = self.matrices.get(dim, (np.empty(0, np.int64), np.empty((0, dim), np.int64)))
        for at in range(0, len(numbers), _BLOCK):
            yield numbers[at : at + _BLOCK], matrix[at : at + _BLOCK]


@dataclass
class Windows:
    """The windows of a pass, and how far each is cut. A row's key is its loss, the positive's score less its own; where very many rows tie at
    the loss of the k-th, `tie`, the key of those is their id. Of keys from `low` on, `need` rows are wanted; buckets are 2**shift wide."""

    anchor: np.ndarray
    positive: np.ndarray
    score: np.ndarray

    def __post_init__(self) -> None:
        n, self.digit = len(self.anchor), DIGIT
        self.span = self.score // 5  # 80 * positive <= 100 * score: the loss is a fifth at most
        self.need, self.low = np.full(n, NEGATIVES, np.int64), np.zeros(n, np.uint64)
        self.shift = np.array([max(0, int(s).bit_length() - self.digit) for s in self.span], np.uint64)
        self.tie, self.done = np.full(n, -1, np.int64), np.zeros(n, bool)
        self.limit, self.last_id = self.span.astype(np.uint64), np.full(n, np.iinfo(np.uint64).max, np.uint64)
        order = np.argsort(self.anchor, kind="stable")
        bounds = np.searchsorted(self.anchor[order], np.arange(self.anchor.max(initial=-1) + 2))
        self.of = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def of_anchor(self, number: int) -> np.ndarray:
        return self.of[number] if number < len(self.of) else np.empty(0, np.int64)

    def keys(self, w: int, loss: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Keys, from `low`, of the window's rows that are still to be told apart. loss, ids: of rows of other labels, unsigned."""
        if self.tie[w] >= 0:
            return ids[loss == np.uint64(self.tie[w])] - self.low[w]
        return loss[loss <= np.uint64(self.span[w])] - self.low[w]

    def cut(self, w: int, bucket: int | None, upto: int, inside: int) -> None:
        """Go on with the bucket of the k-th row: `upto` rows stand up to its end, `inside` in it. None: there are fewer rows than wanted."""
        if bucket is None:
            self.done[w] = True
            return
        first, end = int(self.low[w]) + (bucket << int(self.shift[w])), int(self.low[w]) + ((bucket + 1) << int(self.shift[w])) - 1
        by_id = self.tie[w] >= 0
        if upto <= FEW or by_id and not self.shift[w]:
            (self.last_id if by_id else self.limit)[w] = end
            self.done[w] = True
            return
        self.need[w] -= upto - inside
        self.low[w] = first
        if self.shift[w]:
            self.shift[w] = max(0, int(self.shift[w]) - self.digit)
        else:  # many rows of one score
            self.tie[w] = self.limit[w] = first
            self.low[w], self.shift[w] = 0, 64 - self.digit


def _ordered(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers of the same order."""
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


def _met(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor's number, and ids, labels and scores of the rows it meets."""
    for batch in batches:
        if not len(batch):
            continue
        for ids, labels, v in _vectors(batch):
            for numbers, matrix in anchors.blocks(v.shape[1]):
                for number, scores in zip(numbers, products(matrix, v), strict=True):
                    yield int(number), ids, labels, scores


def _positives(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[pa.RecordBatch]:
    for number, ids, labels, scores in _met(batches, anchors):
        own = np.flatnonzero((labels == anchors.labels[number]) & (ids != anchors.ids[number]))
        best = own[np.lexsort((ids[own], -scores[own]))][:POSITIVES]
        if len(best):
            yield pa.RecordBatch.from_pydict({"anchor": np.full(len(best), number), "id": ids[best], "score": scores[best]})


def _counted(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows) -> Iterator[pa.RecordBatch]:
    """window, need, bucket and the number of this task's rows in it."""
    buckets = 1 << windows.digit
    found = np.zeros((len(windows.anchor), buckets), np.int64)
    for number, ids, labels, scores in _met(batches, anchors):
        open_ = [w for w in windows.of_anchor(number) if not windows.done[w]]
        if open_:
            other = labels != anchors.labels[number]
            theirs, their_ids = scores[other], _ordered(ids[other])
            for w in open_:
                bucket = windows.keys(w, (windows.score[w] - theirs).view(np.uint64), their_ids) >> windows.shift[w]
                found[w] += np.bincount(bucket[bucket < buckets].astype(np.int64), minlength=buckets)
    w, bucket = np.nonzero(found)
    yield pa.RecordBatch.from_pydict({"window": w, "need": windows.need[w], "bucket": bucket, "n": found[w, bucket]})


def _gathered(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows) -> Iterator[pa.RecordBatch]:
    """Rows up to each window's k-th; of a batch the first k, since rows may be alike in score and id."""
    for number, ids, labels, scores in _met(batches, anchors):
        other = labels != anchors.labels[number]
        theirs, their_ids = scores[other], ids[other]
        for w in windows.of_anchor(number):
            loss, order = (windows.score[w] - theirs).view(np.uint64), _ordered(their_ids)
            near = loss <= windows.limit[w]
            if windows.tie[w] >= 0:
                near &= (loss < np.uint64(windows.tie[w])) | (order <= windows.last_id[w])
            near = np.flatnonzero(near)
            near = near[np.lexsort((their_ids[near], -theirs[near]))][:NEGATIVES]
            if len(near):
                same = {"window": w, "anchor_id": anchors.ids[number], "positive_id": windows.positive[w], "positive_score": windows.score[w]}
                yield pa.RecordBatch.from_pydict({c: np.full(len(near), x, np.int64) for c, x in same.items()} | {"negative_id": their_ids[near], "negative_score": theirs[near]})


def _anchors(asked: DataFrame) -> Anchors:
    table = asked.toArrow().combine_chunks()
    ids, labels, matrices, at = [], [], {}, 0
    for batch in table.to_batches():
        for i, kind, v in _vectors(batch):
            if len(i):
                ids.append(i)
                labels.append(kind)
                matrices.setdefault(v.shape[1], []).append((np.arange(at, at + len(i)), v))
                at += len(i)
    joined = {dim: tuple(np.concatenate(x) for x in zip(*some, strict=True)) for dim, some in matrices.items()}
    whole = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
    return Anchors(whole(ids), whole(labels), joined)


def _pass(rows: DataFrame, anchors: Anchors) -> DataFrame:
    """The negatives of some anchors."""
    shared = rows.sparkSession.sparkContext.broadcast
    asked = shared(anchors)

    def scan(fn, schema: str, windows: Windows | None = None) -> DataFrame:  # noqa: ANN001
        state = shared(windows) if windows else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return fn(batches, asked.value, state.value) if state else fn(batches, asked.value)

        return map_batches(rows, run, schema, rows=1 << 13)

    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    best = scan(_positives, "anchor long, id long, score long").withColumn("nth", nth).where(F.col("nth") <= POSITIVES).where("score >= 0")
    found = best.orderBy("anchor", "nth").toArrow()  # POSITIVES rows an anchor
    windows = Windows(*[found.column(c).to_numpy() for c in ("anchor", "id", "score")])
    while not windows.done.all():
        counts = scan(_counted, "window long, need long, bucket long, n long", windows).groupBy("window", "need", "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("window").orderBy("bucket"))
        reached = counts.withColumn("upto", upto).where("upto >= need").groupBy("window").agg(F.min(F.struct("bucket", "upto", "n")).alias("b")).select("window", "b.*")
        where = {r["window"]: r for r in reached.toArrow().to_pylist()}  # a row a window
        for w in np.flatnonzero(~windows.done):
            r = where.get(int(w))
            windows.cut(int(w), r and r["bucket"], r and r["upto"], r and r["n"])
    kept = scan(_gathered, "window long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", windows)
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("negative_score"), "negative_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES)


def mine(table: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, of every row whose vec_id is divisible by ANCHOR_EVERY as an anchor.

    table: vec_id, label, embedding. Anchors go to the tasks as a matrix, PASS_BYTES and PASS_WINDOWS at most; more take more passes.
    """
    rows = rows_of(table)
    asked = rows.where(F.col("id") % ANCHOR_EVERY == 0).distinct()
    size = asked.agg(F.count("*").alias("n"), F.sum(8 * F.size("v").cast("long")).alias("bytes")).first()
    passes = max(1, -(-size.n * POSITIVES // PASS_WINDOWS), -(-(size.bytes or 0) // PASS_BYTES))
    found = []
    for at in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(passes)) == at)
        each = _pass(rows, _anchors(part))
        found.append(each if passes == 1 else materialise(each, "hard-negatives"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(table: DataFrame) -> DataFrame:
    return mine(table)


ORACLE = f"""
WITH e AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label::BIGINT + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM e a JOIN e r ON a.id <> r.id AND len(a.v) = len(r.v) WHERE a.id % {ANCHOR_EVERY} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score QUALIFY rank <= {NEGATIVES}"""
