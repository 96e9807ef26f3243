"""Field-weighted lexical search over stored positional postings: BM25F with coverage, prefix expansion and proximity, for many questions at once.

A document's postings lie together, in the order of terms. Questions meet them by an equality join on terms; what is matched of a document
is then scored against all questions of a pass in one block, so hits are never shuffled, and only what can still be among the best leaves
a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.storage import materialise

K1, B = 1.2, 0.75
PREFIX_LENGTH, PREFIX_DISCOUNT = 5, 0.45
GAP = 1000  # between the positions of two fields
#: Most pairs of a question and a term that it reaches in a pass: about 64 MB in every task.
PASS = 2_000_000
#: So many terms at most go to the postings, which else meet them in a shuffled join.
FEW_TERMS = 250_000
#: Documents of a block.
BLOCK = 128


@dataclass(frozen=True)
class Index:
    """Stored postings (id, term, `tf_` and `n_` of each field, positions), the number of documents and the mean length of each field."""

    postings: DataFrame
    fields: dict[str, float]
    docs: int
    means: dict[str, float]

    def weighted(self) -> Column:
        """The field-weighted, length-normalised frequency of a posting."""
        parts = [F.lit(float(w)) * F.col(f"tf_{f}") / (1 - B + B * F.col(f"n_{f}") / self.means[f]) for f, w in self.fields.items()]
        return reduce(lambda a, b: a + b, parts)


def _postings(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[pa.RecordBatch]:
    """Postings of placed terms (id, f, at, term) that come document by document; a document is held until its last term is seen."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        cut = int(np.flatnonzero(ids != ids[-1]).max(initial=-1)) + 1  # where the last document of the batch begins
        if cut == 0 and held and held[-1].column("id")[-1].as_py() == batch.column("id")[0].as_py():
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield from _written(pa.Table.from_batches(held).combine_chunks(), fields)
        held = [batch.slice(cut)]
    if held:
        yield from _written(pa.Table.from_batches(held).combine_chunks(), fields)


def _written(rows: pa.Table, fields: int) -> Iterator[pa.RecordBatch]:
    """The postings of whole documents, in the order of documents and terms."""
    doc = np.unique(rows.column("id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), return_inverse=True)[1]
    f, at = rows.column("f").to_numpy(), rows.column("at").to_numpy()
    words = rows.column("term").combine_chunks().dictionary_encode()
    rank = np.empty(len(words.dictionary), np.int64)
    rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank))
    order = np.lexsort((at, f, doc))
    doc, f, term = doc[order], f[order], rank[words.indices.to_numpy()[order]]
    n = int(doc[-1]) + 1
    sizes = np.array([np.bincount(doc[f == i], minlength=n) for i in range(fields)])
    pos = np.arange(len(doc)) - (np.cumsum(sizes.sum(0)) - sizes.sum(0))[doc] + GAP * f
    by_term = np.argsort(doc * len(rank) + term, kind="stable")
    key = (doc * len(rank) + term)[by_term]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    of_doc, f = key[starts] // len(rank), f[by_term]
    tf = [np.bincount(group[f == i], minlength=len(starts)) for i in range(fields)]
    source = pa.array(order[by_term[starts]])
    columns = [rows.column("id").combine_chunks().take(source), rows.column("term").combine_chunks().take(source)]
    columns += [pa.array(x.astype(np.int32)) for x in [*tf, *sizes[:, of_doc]]]
    positions = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(key)].astype(np.int32)), pa.array(pos[by_term].astype(np.int32)))
    first = pa.array(np.r_[True, of_doc[1:] != of_doc[:-1]])
    names = ["id", "term", *[f"tf_{i}" for i in range(fields)], *[f"n_{i}" for i in range(fields)], "positions", "first"]
    yield pa.RecordBatch.from_arrays([*columns, positions, first], names)


def postings(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """Postings of documents (id and the fields). Whole texts are dealt and sorted by id; their terms, many times the texts, are never shuffled,
    sorted or hashed by Spark, but put together document by document, so a task holds one document's terms and a batch."""
    whole = docs.select("id", *[F.col(f).cast("string").alias(f) for f in fields]).repartition("id").sortWithinPartitions("id")
    each = whole.select("id", F.posexplode(F.array(*fields)).alias("f", "body"))
    placed = tx.term_rows(each, "body", "id", "f", placed=True).select("id", "f", "at", "term")
    n, kind = len(fields), docs.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c}_{i} int" for c in ("tf", "n") for i in range(n))
    found = placed.mapInArrow(lambda b: _postings(b, n), f"id {kind}, term string, {counts}, positions array<int>, first boolean")
    return found.select("id", "term", *[F.col(f"{c}_{i}").alias(f"{c}_{f}") for c in ("tf", "n") for i, f in enumerate(fields)], "positions", "first")


def index(docs: DataFrame, fields: dict[str, float]) -> Index:
    """The index of documents: id and the fields. Texts are read here and not again. Positions run through all fields, GAP apart."""
    stored = materialise(postings(docs, fields), "postings")
    means = stored.where("first").agg(*[F.avg(F.when(F.col(f"n_{f}") > 0, F.col(f"n_{f}"))).alias(f) for f in fields]).first()
    return Index(stored, fields, docs.count(), {f: float(means[f] or 1.0) for f in fields})


def idf(n: Column | int, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def reached(queries: DataFrame, idx: Index) -> DataFrame:
    """qid, wanted, worth (of the wanted term), term and discount: the index terms that each term of a question reaches; a null term if none.

    queries: qid, term, weight. A query term finds itself, and longer terms that start with it at a discount.
    """
    df = materialise(idx.postings.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    asked = queries.groupBy("qid", F.col("term").alias("wanted")).agg(F.max("weight").alias("weight"))
    worth = idf(idx.docs, F.coalesce("df", F.lit(0))) * F.col("weight")
    known = asked.join(df.withColumnRenamed("term", "wanted"), "wanted", "left").select("qid", "wanted", worth.alias("worth"))
    reach = prefix_terms(asked.select(F.col("wanted").alias("term")).distinct(), df.select("term"))
    return known.join(reach.withColumnRenamed("weight", "discount"), "wanted", "left").select("qid", "wanted", "worth", "term", "discount")


def of_terms(idx: Index, terms: DataFrame) -> DataFrame:
    """The postings of the terms asked for, taken where they lie, so that the others are not shuffled. terms: a stored table with `term`."""
    asked = terms.select("term").distinct()
    return idx.postings.join(F.broadcast(asked) if asked.count() <= FEW_TERMS else asked, "term", "left_semi")


class Asked:
    """The questions of a pass as arrays: for each number of a term, the questions it serves with what it is worth to them."""

    def __init__(self, reach: pa.Table) -> None:
        qid, wanted = reach.column("qid").to_numpy(), reach.column("wanted").to_numpy(zero_copy_only=False)
        worth, term, discount = reach.column("worth").to_numpy(), reach.column("term").to_pylist(), reach.column("discount").to_numpy(zero_copy_only=False)
        self.qids, q = np.unique(qid, return_inverse=True)
        pairs: dict[tuple, int] = {}
        pair = np.fromiter((pairs.setdefault(x, len(pairs)) for x in zip(q.tolist(), wanted.tolist(), strict=True)), np.int64, len(q))
        self.pair_q, self.pair_worth = np.zeros(len(pairs), np.int64), np.zeros(len(pairs))
        self.pair_q[pair], self.pair_worth[pair] = q, worth
        self.total = np.bincount(self.pair_q, self.pair_worth, len(self.qids))
        self.terms = sorted({t for t in term if t is not None})
        number = {t: i for i, t in enumerate(self.terms)}
        at = np.array([number.get(t, -1) for t in term], np.int64)
        order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
        self.start = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        self.pair, self.discount = pair[order], discount[order].astype(float)

    def scores(self, docs: int, doc: np.ndarray, term: np.ndarray, tfn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """bm25 and coverage of `docs` documents (rows) for all questions (columns), from matched postings (document, term's number, frequency).

        Expansions add to the score, but a document is credited with each query term once, at its best."""
        n, sizes = len(self.qids), self.start[term + 1] - self.start[term]
        hit = np.repeat(self.start[term] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        pair, of_doc, less = self.pair[hit], np.repeat(doc, sizes), self.discount[hit]
        cell = of_doc * n + self.pair_q[pair]
        bm25 = np.bincount(cell, self.pair_worth[pair] * less * np.repeat(tfn / (K1 + tfn), sizes), docs * n)
        best = np.zeros(docs * len(self.pair_q))
        key, whole = of_doc * len(self.pair_q) + pair, less == 1.0
        best[key[~whole]], best[key[whole]] = PREFIX_DISCOUNT, 1.0  # the second overwrites the first
        seen = np.flatnonzero(best)
        row, pair = np.divmod(seen, max(1, len(self.pair_q)))
        credit = np.bincount(row * n + self.pair_q[pair], self.pair_worth[pair] * best[seen], docs * n)
        share = np.divide(credit.reshape(docs, n), self.total, out=np.zeros((docs, n)), where=self.total > 0)
        return bm25.reshape(docs, n), np.minimum(1.0, share)


class Best:
    """The k best scores of each question that a task has met."""

    def __init__(self, questions: int, k: int) -> None:
        self.held = np.full((questions, k), -np.inf)

    def admit(self, scores: np.ndarray, room: float) -> np.ndarray:
        """Which scores (documents by questions), lifted by `room`, still reach the k-th best."""
        k = self.held.shape[1]
        every = np.concatenate([self.held, scores.T], 1)
        self.held = np.partition(every, every.shape[1] - k, 1)[:, -k:]
        return scores + room >= self.held.min(1)[None, :]


def passes(reach: DataFrame) -> Iterator[pa.Table]:
    """The rows of a stored `reach` in passes of whole questions, of PASS rows at most unless one question has more."""
    n = -(-reach.count() // PASS)
    for at in range(n):
        part = reach if n == 1 else reach.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == at)
        yield part.toArrow()


def matched(idx: Index, asked: Asked) -> DataFrame:
    """id, terms and tfn of the documents that hold terms of a pass: their matched postings, by the numbers of the terms."""
    spark = idx.postings.sparkSession
    numbers = spark.createDataFrame(pa.table({"term": pa.array(asked.terms, pa.string()), "no": pa.array(range(len(asked.terms)), pa.int32())}))  # PASS terms at most
    hits = idx.postings.join(F.broadcast(numbers), "term").select("id", "no", idx.weighted().alias("tfn"))
    each = hits.groupBy("id").agg(F.collect_list(F.struct("no", "tfn")).alias("m"))
    return each.select("id", F.col("m.no").alias("terms"), F.col("m.tfn").alias("tfn"))


def blocks(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of at most BLOCK documents (id, terms, tfn and what else there is) with their bm25 and coverage."""
    for whole in batches:
        for at in range(0, len(whole), BLOCK):
            batch = whole.slice(at, BLOCK)
            lists = batch.column("terms").combine_chunks() if isinstance(batch.column("terms"), pa.ChunkedArray) else batch.column("terms")
            sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(batch)), sizes)
            yield batch, *asked.scores(len(batch), doc, lists.flatten().to_numpy().astype(np.int64), batch.column("tfn").flatten().to_numpy())


_FOUND = "qid long, id long, kind string, bm25 double, coverage double"


def search(queries: DataFrame, idx: Index, k: int, kinds: DataFrame | None = None) -> DataFrame:
    """qid, id, kind, bm25 and coverage of what can be among the k best of each question when scores are rounded to six digits: each task
    gives the documents that reach its k best. With `kinds` (id, kind) k of each kind are asked for. queries: qid, term, weight."""
    found = []
    for reach in passes(materialise(reached(queries, idx), "reach")):
        asked = Asked(reach)
        shared = idx.postings.sparkSession.sparkContext.broadcast(asked)

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            best: dict = {}
            for batch, bm25, coverage in blocks(batches, shared.value):
                names, good = batch.column("kind").to_pylist(), np.zeros_like(bm25, bool)
                for kind in set(names):
                    rows = [i for i, x in enumerate(names) if x == kind]
                    good[rows] = best.setdefault(kind, Best(len(shared.value.qids), k)).admit(bm25[rows], 2e-6)
                d, q = np.nonzero(good & (bm25 > 0))
                columns = {"qid": shared.value.qids[q], "id": batch.column("id").to_numpy()[d], "kind": pa.array([names[i] for i in d], pa.string())}
                yield pa.RecordBatch.from_pydict(columns | {"bm25": bm25[d, q], "coverage": coverage[d, q]})

        docs = matched(idx, asked)
        docs = docs.join(kinds.select("id", F.col("kind").cast("string").alias("kind")), "id") if kinds is not None else docs.withColumn("kind", F.lit(""))
        found.append(docs.mapInArrow(score, _FOUND))
    return reduce(DataFrame.unionByName, found) if found else idx.postings.sparkSession.createDataFrame([], _FOUND)


def top(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k best of each qid, ties to the smaller id. The window is limited, so each task keeps k rows a query before the shuffle."""
    best = Window.partitionBy("qid").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def prefix_terms(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Index terms of each wanted term: itself at 1, and strictly longer ones that start with it (5 letters or more) at a
    discount. Both sides meet on their first letters, so this is an equality join with a residual test."""
    key = F.substring("term", 1, PREFIX_LENGTH)
    asked = wanted.select(F.col("term").alias("wanted"), key.alias("p"))
    long = asked.where(F.length("wanted") >= PREFIX_LENGTH)
    have = vocabulary.select("term", key.alias("p"))
    longer = long.join(have, "p").where(F.col("term").startswith(F.col("wanted")) & (F.length("term") > F.length("wanted")))
    same = asked.join(vocabulary, asked["wanted"] == vocabulary["term"])
    return same.select("wanted", "term", F.lit(1.0).alias("weight")).unionByName(longer.select("wanted", "term", F.lit(PREFIX_DISCOUNT).alias("weight")))


def spans(pairs: DataFrame, reach: DataFrame, idx: Index) -> DataFrame:
    """qid, id, kinds and span of pairs (qid, id): how many terms of the question the document reaches, and the least distance from the first
    to the last of positions that hold them all. reach: qid, wanted, term. Only the positions of matched postings are read."""
    terms = reach.where("term IS NOT NULL").select("qid", "wanted", "term")
    places = of_terms(idx, terms).select("id", "term", "positions")
    met = pairs.select("qid", "id").join(terms, "qid").join(places, ["id", "term"])
    lists = met.groupBy("qid", "id", "wanted").agg(F.flatten(F.collect_list("positions")).alias("p"))
    per = lists.groupBy("qid", "id").agg(F.collect_list("p").alias("lists")).select("qid", "id", F.size("lists").alias("kinds"), "lists")
    marks = F.array_sort(F.flatten(F.transform("lists", lambda p, i: F.transform(p, lambda x: F.struct(x.alias("pos"), i.alias("term"))))))
    return per.select("qid", "id", "kinds", window_span(marks, F.col("kinds")).alias("span"))


def window_span(marks: Column, n: Column | int) -> Column:
    """The least distance from the first to the last of positions that hold all n terms, or null. marks: array of (pos, term), sorted; terms
    are numbered from 0."""
    count = n if isinstance(n, Column) else F.lit(n)
    start = F.struct(F.array_repeat(F.lit(-1), count).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(acc: Column, m: Column) -> Column:
        last = F.transform(acc["last"], lambda x, i: F.when(i == m["term"], m["pos"]).otherwise(x))
        low = F.array_min(last)
        return F.struct(last.alias("last"), F.when(low >= 0, F.least(acc["best"], m["pos"] - low)).otherwise(acc["best"]).alias("best"))

    return F.aggregate(marks, start, step, lambda acc: acc["best"])
