"""Fused retrieval: lexical, vector and name channels over filtered records, for many questions in one plan.

Texts are read once, for the index. Every record then meets all questions of a pass in one block of numbers: first for the maxima of each
question, then for its score without proximity, which is exact. Only records that proximity could still lift to the k-th best leave a
task; proximity is computed for those that it could lift among all, from the positions of matched terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import analysis
from quern.operators import lexical, names
from quern.storage import materialise

# Weights of the channels, the mix within the lexical one, saturation of names, bonus of a hinted type, window.
LEXICAL, DENSE, NAME, HINT = 0.55, 0.30, 1.6, 0.08
BM25, COVERAGE, PROXIMITY = 0.55, 0.30, 0.15
SATURATION, WINDOW = 2.0, 10
RESULT = ["qid", "id", "score", "rank", "bm25", "coverage", "proximity", "name", "dense", "candidates"]


def questions(asked: DataFrame) -> DataFrame:
    """qid, term and weight of questions (qid, text)."""
    return asked.select("qid", F.inline(analysis.analyse("text")["terms"]))


def proximity(pairs: DataFrame, reach: DataFrame, idx: lexical.Index) -> DataFrame:
    """qid, id and proximity of pairs (qid, id): how near all matched terms of a question stand in a record, 0 for one term alone.

    reach: as `lexical.reached` gives it.
    """
    terms = reach.groupBy("qid").agg(F.count_distinct("wanted").alias("asked"))
    found = lexical.spans(pairs, reach, idx).join(terms, "qid")
    score = F.when((F.col("kinds") >= 2) & (F.col("asked") >= 2), F.col("kinds") / F.col("asked") * WINDOW / (WINDOW + F.col("span"))).otherwise(0.0)
    return found.select("qid", "id", score.alias("proximity"))


@dataclass
class _Pass:
    """What the tasks of a pass share: the questions' terms, hinted types, vectors (rows of zeros where there is none) and, later, maxima."""

    asked: lexical.Asked
    hints: list[set]
    vectors: np.ndarray | None
    top: np.ndarray
    peak: np.ndarray


def _parts(batches: Iterator[pa.RecordBatch], shared: _Pass) -> Iterator[tuple]:
    """Runs of records with bm25, coverage and dot products for all questions."""
    for batch, bm25, coverage in lexical.blocks(batches, shared.asked):
        dots = np.zeros_like(bm25)
        if shared.vectors is not None:
            v = batch.column("v")
            has = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            if len(has):
                dots[has] = np.maximum(0.0, v.drop_null().flatten().to_numpy().reshape(len(has), -1) @ shared.vectors.T)
        yield batch, bm25, coverage, dots


def _maxima(batches: Iterator[pa.RecordBatch], shared: _Pass) -> Iterator[pa.RecordBatch]:
    top, peak = np.zeros(len(shared.asked.qids)), np.zeros(len(shared.asked.qids))
    for _, bm25, _, dots in _parts(batches, shared):
        top, peak = np.maximum(top, bm25.max(0)), np.maximum(peak, dots.max(0))
    yield pa.RecordBatch.from_pydict({"qid": shared.asked.qids, "top": top, "peak": peak})


_SURE = "qid long, id long, kind string, bm25 double, coverage double, name double, dense double, sure double, room double"


def _candidates(batches: Iterator[pa.RecordBatch], shared: _Pass, k: int, by_kind: bool) -> Iterator[pa.RecordBatch]:
    """Records whose score without proximity, and all that proximity could add, reaches the k-th best of the task, of a kind if `by_kind`."""
    n, best = len(shared.asked.qids), {}
    place = {int(q): i for i, q in enumerate(shared.asked.qids)}
    for batch, bm25, coverage, dots in _parts(batches, shared):
        lex = np.divide(bm25, shared.top, out=np.zeros_like(bm25), where=shared.top > 0) * BM25 + np.where(shared.top > 0, coverage, 0.0) * COVERAGE
        dense = np.divide(dots, shared.peak, out=np.zeros_like(dots), where=shared.peak > 0)
        name, kinds = np.zeros_like(bm25), batch.column("kind").to_pylist()
        for d, found in enumerate(batch.column("names").to_pylist()):
            for x in found or ():
                if x["qid"] in place:
                    name[d, place[x["qid"]]] = x["name"]
        bonus = np.array([[HINT if kind in h else 0.0 for h in shared.hints] for kind in kinds])
        sure, room = LEXICAL * lex + NAME * name + bonus + DENSE * dense, np.where(lex > 0, LEXICAL * PROXIMITY, 0.0)
        admitted = np.zeros_like(sure, bool)
        groups = {kind: np.array([i for i, x in enumerate(kinds) if x == kind]) for kind in set(kinds)} if by_kind else {None: np.arange(len(batch))}
        for kind, rows in groups.items():
            admitted[rows] = best.setdefault(kind, lexical.Best(n, k)).admit(sure[rows], LEXICAL * PROXIMITY)
        d, q = np.nonzero(admitted & (sure > 0))
        columns = {"bm25": bm25, "coverage": coverage, "name": name, "dense": dense, "sure": sure, "room": room}
        kind_of = pa.array([kinds[i] for i in d], pa.string())
        yield pa.RecordBatch.from_pydict({"qid": shared.asked.qids[q], "id": batch.column("id").to_numpy()[d], "kind": kind_of} | {c: x[d, q] for c, x in columns.items()})


def retrieve(
    asked: DataFrame,
    docs: DataFrame,
    fields: dict[str, float],
    vectors: DataFrame | None = None,
    asked_vectors: DataFrame | None = None,
    lexicon: DataFrame | None = None,
    k: int = 10,
    least: float = 0.0,
    by_kind: bool = False,
) -> DataFrame:
    """qid, id, score, rank, the parts of the k best records of each question, of a score above 0 and of `least` at least, and `candidates`,
    how many records of a question were scored in full. Exact: what is left out cannot be among the k best.

    asked: qid, text. docs: id, kind and the fields, filtered before: maxima are those of the filtered records. vectors: id, v;
    asked_vectors: qid, v. Without vectors or a lexicon their channels are 0. `by_kind` keeps k of each kind.
    """
    idx = lexical.index(docs, fields)
    with_vectors = vectors is not None and asked_vectors is not None
    rows = docs.select("id", "kind")
    doubles = lambda v: F.transform(v, lambda x: x.cast("double"))
    if with_vectors:
        rows = rows.join(vectors.select("id", doubles("v").alias("v")), "id", "left")
    named = F.lit(None).cast("array<struct<qid:long,name:double>>")
    if lexicon is not None:
        boosts = names.total(names.scan(asked, lexicon)).select("id", F.struct(F.col("qid").cast("long").alias("qid"), F.least(F.lit(1.0), F.col("boost") / SATURATION).alias("name")).alias("x"))
        rows, named = rows.join(boosts.groupBy("id").agg(F.collect_list("x").alias("names")), "id", "left"), F.col("names")
    rows = rows.withColumn("names", named)
    every = asked.select("qid", analysis.analyse("text").alias("a")).select("qid", F.col("a.hints").alias("hints"), F.inline_outer("a.terms"))
    every = materialise(every, "question-terms")
    reach = materialise(lexical.reached(every.select("qid", "term", "weight"), idx), "reach")
    nth = ["qid", "kind"] if by_kind else ["qid"]
    share = rows.sparkSession.sparkContext.broadcast
    found = []
    for table in lexical.passes(reach):
        of_pass = lexical.Asked(table)
        hints = {r.qid: set(r.hints) for r in every.select("qid", "hints").distinct().collect()}
        near = {r.qid: r.v for r in asked_vectors.select("qid", doubles("v").alias("v")).collect()} if with_vectors else {}
        dim = max(map(len, near.values()), default=0)
        matrix = np.array([near.get(q, [0.0] * dim) for q in of_pass.qids.tolist()]) if dim else None
        none = np.zeros(len(of_pass.qids))
        met = rows.join(lexical.matched(idx, of_pass), "id", "left")
        met = materialise(met, "matched")
        first = share(_Pass(of_pass, [hints.get(q, set()) for q in of_pass.qids.tolist()], matrix, none, none))
        peaks = met.mapInArrow(lambda b, s=first: _maxima(b, s.value), "qid long, top double, peak double").groupBy("qid").agg(F.max("top").alias("top"), F.max("peak").alias("peak"))
        peaks = {r.qid: r for r in peaks.collect()}
        top, peak = (np.array([peaks[q][c] if q in peaks else 0.0 for q in of_pass.qids.tolist()]) for c in ("top", "peak"))
        second = share(_Pass(of_pass, first.value.hints, matrix, top, peak))
        found.append(materialise(met.mapInArrow(lambda b, s=second: _candidates(b, s.value, k, by_kind), _SURE), "candidates"))
    if not found:
        return rows.sparkSession.createDataFrame([], "qid long, id long, kind string, score double, rank int, bm25 double, coverage double, proximity double, name double, dense double, candidates long").select(*RESULT)
    sure = reduce(DataFrame.unionByName, found)
    bar = sure.withColumn("nth", F.row_number().over(Window.partitionBy(*nth).orderBy(F.desc("sure")))).where(F.col("nth") == k).select(*nth, F.col("sure").alias("bar"))
    kept = sure.join(bar, nth, "left").where(F.col("bar").isNull() | (F.col("sure") + F.col("room") >= F.col("bar") - 1e-9)).drop("bar")
    close = proximity(kept.where("room > 0"), reach, idx)
    whole = kept.join(close, ["qid", "id"], "left").na.fill(0.0, ["proximity"]).withColumn("candidates", F.count("*").over(Window.partitionBy("qid")))
    score = F.round(F.col("sure") + F.when(F.col("room") > 0, LEXICAL * PROXIMITY * F.col("proximity")).otherwise(0.0), 6)
    scored = whole.withColumn("score", score).where((F.col("score") > 0) & (F.col("score") >= least))
    rank = F.row_number().over(Window.partitionBy(*nth).orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(*RESULT)


def recommendable(results: DataFrame, records: DataFrame) -> DataFrame:
    """Results that may be recommended: those whose record is known and not closed. records: id, closed."""
    return results.join(records.where(~F.coalesce("closed", F.lit(False))).select("id"), "id", "left_semi")


def next_page(results: DataFrame, seen: DataFrame, size: int, by: list[str] | None = None) -> DataFrame:
    """The first `size` results of each question (or of each `by`) that were not seen (qid, id). results: qid, id, rank, fetched with room for
    the seen."""
    fresh = results.join(seen, ["qid", "id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy(*(by or ["qid"])).orderBy("rank"))
    return fresh.withColumn("place", nth).where(F.col("place") <= size)
