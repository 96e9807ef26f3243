"""Log-bilinear language model trained with noise-contrastive estimation.

Tokens are the words of a text (A-Z lower-cased) and one end. The model predicts a token's class from the two tokens before it:
score(w | v1, v2) = (r[v1] M1 + r[v2] M2) . q[w] + b[w]. Classes are the end, the CLASS_WORDS most frequent words, and BUCKETS
buckets of all other words by their last two bytes. Every word of a bucket that training has seen has an embedding of its own, and a
second softmax inside the bucket predicts it from the token before: score(w | u) = s[u] . e[w] + c[w], where u is the context
that stands for the token (the end, each of the FINE most frequent words, and COARSE groups of all others). What training has not
seen has a fixed small share of its bucket. So all words seen in training, and one more per bucket, share a probability of one.

Training documents are dealt by a hash to shards of about SHARD_TOKENS tokens, in order of that hash within a shard. Every shard
runs NCE over all its tokens from common parameters, and the parameters are averaged by tokens, in fixed point, so that the result
does not depend on how the rows lay; ROUNDS such rounds. As the score is a sum over the two contexts, the normaliser of every pair of contexts
is one product of two matrices, exp(A1) diag(exp b) exp(A2)^T, and a token's log-probability is four table look-ups.

The second softmax is learnt bucket by bucket, by NCE over the counts of (context, word) with noise from the bucket; a bucket of more than
UNIT_TOKENS tokens is dealt to several units by a hash of the document, which are averaged. A bucket's embeddings and its normalisers for all
contexts are one row of a stored table, so no vocabulary passes through one task or the driver.

Counts cover all training documents. The most frequent words (of at most LONGEST bytes; as many counts as fit into DICTIONARY
words) are broadcast with their embeddings, which bounds them; all rarer words meet counts and embeddings in a shuffled join.

Defined results: a null or empty text is its end alone. Repeated rows are counted and scored each. Without training
documents every count is 0 and the classes are alike. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fold_of, freeing, map_batches, materialise, new_path, remove, stored, texts_of

FOLDS, HELD_OUT = 7, 2
CLASS_WORDS = 1024
BUCKETS = 255
DICTIONARY = 200_000
LONGEST = 64
WIDTH = 16
ROUNDS = 2
BATCH = 2048
NOISE = 48
RATE = 0.1
SEED = 3
END = "\n"  # no word holds it
SHARD_TOKENS = 1 << 21
#: Contexts of the second softmax, its width, tokens of a unit that learns it, and of a chunk that a task counts at a time.
FINE, COARSE = 256, 64
CONTEXTS = 1 + COARSE + FINE
INNER = 8
UNIT_TOKENS = 1 << 22
_CHUNK = 1 << 18
#: Bytes of text that are counted or scored at a time; a token takes some hundred bytes on the way.
_BATCH_BYTES = 1 << 19
_FLUSH = 400_000
_FINE = 10  # counts are told apart by their leading bits when the dictionary's least count is sought
_POINT = float(1 << 44)


def words_in(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def bucket_of(word: bytes) -> int:
    return 1 + zlib.crc32(word[-2:]) % BUCKETS


def count_words(train: DataFrame) -> DataFrame:
    """word, bucket and c, its count over all training documents; the end is the word END."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(seen)
            cols = [pa.array([k.decode("utf-8", "surrogatepass") for k in keys], pa.string()), pa.array([bucket_of(k) if k != END.encode() else 0 for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["word", "bucket", "c"])

        for batch in batches:
            for text in texts_of(batch):
                seen.update(words_in(text))
            if len(batch):
                seen[END.encode()] += len(batch)
            if len(seen) > _FLUSH:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    parts = map_batches(train.select("text"), freeing(count), "word string, bucket int, c long")
    return parts.groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("c").alias("c"))


_PARAMETERS = ("r", "q", "b", "m1", "m2")


@dataclass
class Model:
    """Bounded tables: the dictionary, per-bucket totals, and the class parameters."""

    words: dict[bytes, int]  # dictionary word -> its row in the two arrays below
    classes: np.ndarray
    log_counts: np.ndarray
    known: np.ndarray
    bucket_logs: np.ndarray
    noise: np.ndarray
    tokens: int
    distinct: int
    least: int | None = None  # the least count of the dictionary's words
    words_e: np.ndarray = field(default_factory=lambda: np.zeros((0, INNER)))  # of the dictionary's rows, in their bucket
    words_c: np.ndarray = field(default_factory=lambda: np.zeros(0))
    inner: np.ndarray = field(default_factory=lambda: np.zeros((0, CONTEXTS, INNER)))  # contexts and normalisers of each bucket
    inner_z: np.ndarray = field(default_factory=lambda: np.zeros((0, CONTEXTS)))
    r: np.ndarray = field(default_factory=lambda: np.zeros(0))
    q: np.ndarray = field(default_factory=lambda: np.zeros(0))
    b: np.ndarray = field(default_factory=lambda: np.zeros(0))
    m1: np.ndarray = field(default_factory=lambda: np.zeros(0))
    m2: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def start(self) -> None:
        rng, n = np.random.default_rng(SEED), len(self.noise)
        self.r, self.q = (rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32) for _ in range(2))
        self.m1, self.m2 = (np.eye(WIDTH, dtype=np.float32) * s for s in (1.0, 0.5))
        self.b = np.log(self.noise).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in _PARAMETERS]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score by (one before, token), with the bias; by (two before, token); log-normaliser by both contexts."""
        a1, a2 = (self.r @ self.m1) @ self.q.T, (self.r @ self.m2) @ self.q.T
        top1, top2 = a1.max(1, keepdims=True), a2.max(1, keepdims=True)
        z = np.exp((a1 - top1 + self.b).astype(np.float64)) @ np.exp((a2 - top2).astype(np.float64)).T
        return a1 + self.b, a2, (np.log(z) + top1 + top2.T).astype(np.float32)


def sequences(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """The tokens of texts one after another: dictionary row (or -1), class, first token of each text, and the words
    outside the dictionary with the index of their text."""
    rows, starts, rare, rare_at, n = [], [], [], [], 0
    get, end = model.words.get, model.words[END.encode()]
    for i, text in enumerate(texts):
        words = words_in(text)
        found = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
        out = [words[k] for k in np.flatnonzero(found < 0).tolist()]
        rare += out
        rare_at += repeat(i, len(out))
        rows += (found, np.array([end], np.int32))
        starts.append(n)
        n += len(words) + 1
    row = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    cls = model.classes[row]
    cls[row < 0] = np.fromiter(map(bucket_of, rare), np.int32, len(rare))
    return row, cls, np.array(starts, np.int64), rare, np.array(rare_at, np.int64)


def contexts(cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before; before a text there is the end, class 0."""
    one = np.concatenate([[0], cls[:-1]])
    two = np.concatenate([[0], one[:-1]])
    two[starts] = 0
    return one, two


def narrow(cls: np.ndarray) -> np.ndarray:
    """The context of the second softmax that a class stands for."""
    fine = (cls > BUCKETS) & (cls <= BUCKETS + FINE)
    return np.where(cls == 0, 0, np.where(fine, cls - BUCKETS + COARSE, 1 + cls % COARSE))


class Trainer:
    """NCE with noise shared by a mini-batch, and Adagrad."""

    def __init__(self, model: Model, seed: list[int]):
        self.model, self.rng, self.tokens = model, np.random.default_rng(seed), 0
        self.p = [x.astype(np.float32).copy() for x in model.parameters()]
        self.g = [np.full_like(x, 1e-3) for x in self.p]
        self.cumulative = np.cumsum(model.noise)
        self.log_noise = np.log(NOISE * model.noise).astype(np.float32)

    def learn(self, one: np.ndarray, two: np.ndarray, cls: np.ndarray) -> None:
        order = self.rng.permutation(len(cls))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            self.step(one[pick], two[pick], cls[pick])
        self.tokens += len(cls)

    def step(self, v1: np.ndarray, v2: np.ndarray, w: np.ndarray) -> None:
        (r, q, b, m1, m2), n = self.p, len(self.model.noise)
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]), n - 1)
        h = (r @ m1)[v1] + (r @ m2)[v2]
        qw, qn = q[w], q[drawn]
        up = 1 - _sigmoid((h * qw).sum(1) + b[w] - self.log_noise[w])
        down = -_sigmoid(h @ qn.T + (b - self.log_noise)[drawn])
        dh = up[:, None] * qw + down @ qn
        dq = _scatter(w, up[:, None] * h, n)
        np.add.at(dq, drawn, down.T @ h)
        db = np.bincount(w, up, n) + np.bincount(drawn, down.sum(0), n)
        d1, d2 = _scatter(v1, dh, n), _scatter(v2, dh, n)
        grads = [d1 @ m1.T + d2 @ m2.T, dq, db, r.T @ d1, r.T @ d2]
        for x, g, d in zip(self.p, self.g, grads, strict=True):
            d = (d / len(w)).astype(np.float32)
            g += d * d
            x += RATE * d / np.sqrt(g)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """By the exponential, which takes half the time of the hyperbolic tangent; one that overflows gives 0."""
    with np.errstate(over="ignore"):
        x = np.exp(-x)
    x += 1
    return np.divide(1, x, out=x)


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of rows by index."""
    width = rows.shape[1]
    cell = at.astype(np.int64)[:, None] * width + np.arange(width)
    return np.bincount(cell.ravel(), rows.ravel(), n * width).reshape(n, width).astype(np.float32)


def frequent(counts: DataFrame) -> list:
    """The most frequent words, most frequent first: all whose count is above the least one at which they are DICTIONARY at most.

    The least count is found from a histogram of counts, of some thousand rows at any size, so nothing else is collected.
    """
    short = counts.where((F.octet_length("word") <= LONGEST) & (F.col("word") != END))
    shift = F.greatest(F.lit(0), F.length(F.conv(F.col("c"), 10, 2)) - _FINE).cast("int")
    keyed = short.withColumn("key", (F.lit(1 << _FINE) * shift).cast("long") + F.call_function("shiftright", F.col("c"), shift))
    least, room = None, DICTIONARY
    for r in sorted(keyed.groupBy("key").agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= r.n
        if room < 0:
            break
        least = r.key
    if least is None:
        return []
    return sorted(keyed.where(F.col("key") >= least).select("word", "bucket", "c").collect(), key=lambda r: (-r.c, r.word.encode()))


def prepare(counts: DataFrame) -> Model:
    """The model's tables from the counts; the dictionary and the bucket totals are all that reaches the driver."""
    top = frequent(counts)
    classed = [r.word for r in top[:CLASS_WORDS]]
    rest = counts.where((F.col("word") != END) & ~F.col("word").isin(classed)) if classed else counts.where("false")
    buckets = {r.bucket: (r.n, r.v) for r in rest.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tokens, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    ends = (counts.where(F.col("word") == END).agg(F.sum("c")).first()[0]) or 0
    words = {END.encode(): 0} | {r.word.encode(): 1 + i for i, r in enumerate(top)}
    of_class = [0, *(1 + BUCKETS + i if i < CLASS_WORDS else r.bucket for i, r in enumerate(top)), 0]  # the last for -1, set apart later
    c = np.array([ends, *(r.c for r in top), 0], np.float64)
    mass = np.zeros(1 + BUCKETS + len(classed))
    mass[0] = ends
    for b, (n, _) in buckets.items():
        mass[b] = n
    mass[1 + BUCKETS :] = [r.c for r in top[:CLASS_WORDS]]
    bucket_logs = np.array([0.0] + [-math.log(sum(buckets.get(b, (0, 0))) + 1) for b in range(1, BUCKETS + 1)])  # the share of the unseen
    model = Model(words, np.array(of_class, np.int32), np.log10(c + 1), c > 0, bucket_logs, (mass + 0.5) / (mass + 0.5).sum(), tokens or 0, distinct, min((r.c for r in top), default=None))
    model.start()
    return model


def shards(model: Model, docs: DataFrame) -> DataFrame:
    """shard, part and `tokens` (the classes of a shard's texts one after another, each closed by the end) of the training documents.

    A text's classes are found once for all rounds. A shard is one row, or more if a very long text makes it too large.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.classes))
    n_shards = max(1, -(-model.tokens // SHARD_TOKENS))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = shared.value
        local = Model(words, classes, *[np.zeros(0)] * 4, 0, 0)
        for batch in batches:
            _, cls, starts, _, _ = sequences(local, texts_of(batch))
            out = [x.astype("<u2").tobytes() for x in np.split(cls, starts[1:])] if len(starts) else []
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("h"), pa.array(out, pa.binary())], ["shard", "h", "tokens"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, held, size = None, 0, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["shard", "part", "tokens"])

        for batch in batches:
            for shard, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if held and (shard != at or size > 4 * SHARD_TOKENS):
                    yield row()
                    part, held, size = (part + 1 if shard == at else 0), [], 0
                at, size = shard, size + len(tokens)
                held.append(tokens)
        if held:
            yield row()

    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").select(F.pmod("h", F.lit(n_shards)).alias("shard"), "h", "text")
    each = map_batches(hashed, freeing(classify), "shard long, h long, tokens binary").repartition("shard").sortWithinPartitions("shard", "h", "tokens")
    return map_batches(each.select("shard", "tokens"), freeing(pack), "shard long, part long, tokens binary", rows=4096)


def train(model: Model, docs: DataFrame) -> Model:
    """Rounds of NCE in every shard over all its tokens, averaged by tokens."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "lm-shards")
    dealt = stored(shards(model, docs), path)

    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model.noise, model.tokens, model.parameters()))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            noise, all_tokens, now = shared.value
            local, total = Model({}, *[np.zeros(0)] * 4, noise, 0, 0, **dict(zip(_PARAMETERS, now, strict=True))), None
            for batch in batches:
                for shard, part, tokens in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "tokens")), strict=True):
                    cls = np.frombuffer(tokens, "<u2").astype(np.int32)
                    starts = np.append(0, np.flatnonzero(cls == 0)[:-1] + 1)  # a text begins after the end of another
                    trainer = Trainer(local, [SEED, turn, shard, part])
                    trainer.learn(*contexts(cls, starts), cls)
                    flat = np.concatenate([x.ravel() for x in trainer.p]).astype(np.float64) * (len(cls) / all_tokens)
                    fixed = np.rint(flat * _POINT).astype(np.int64)  # sums of integers are the same in any order
                    total = fixed if total is None else total + fixed
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

        partial = map_batches(dealt, freeing(run), "v binary", rows=8)
        sums = [bytes(r.v) for r in map_batches(partial.repartition(_LEAVES), freeing(_added), "v binary").collect()]
        if not sums:
            break
        flat = np.sum([np.frombuffer(v, np.int64) for v in sums], axis=0) / _POINT
        sizes = [x.size for x in model.parameters()]
        for name, old, new in zip(_PARAMETERS, model.parameters(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
            setattr(model, name, new.reshape(old.shape).astype(np.float32))
    remove(spark, path)
    return model


#: Partial sums of parameters that reach the driver.
_LEAVES = 8


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for v in batch.column("v").to_pylist():
            part = np.frombuffer(v, np.int64)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def _units(model: Model, docs: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """unit, kind 1, words and data: counts of (context, word) of the bucketed tokens, the words of a chunk numbered in each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.classes))
    parts = np.ones(BUCKETS + 1, np.int64)
    for bucket, n in sizes.items():
        parts[bucket] = max(1, -(-n // UNIT_TOKENS))

    def counted(words: dict[bytes, int], ids: list[np.ndarray], part: list[np.ndarray]) -> pa.RecordBatch:
        known, classes = shared.value
        names = list(words)
        row = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        cls = classes[row].astype(np.int64)
        cls[row < 0] = [bucket_of(names[i]) for i in np.flatnonzero(row < 0).tolist()]
        at, hashed = np.concatenate(ids), np.concatenate(part)
        ids.clear()
        part.clear()
        one = narrow(np.concatenate([[0], cls[at[:-1]]]))
        mine = np.flatnonzero((cls[at] >= 1) & (cls[at] <= BUCKETS) & (hashed >= 0))
        at, one, hashed = at[mine].astype(np.int64), one[mine], hashed[mine]
        unit = cls[at] * (1 << 16) + hashed % parts[cls[at]]
        key, n = np.unique(((unit * CONTEXTS + one) << 24) | at, return_counts=True)
        at, unit, one = key & ((1 << 24) - 1), (key >> 24) // CONTEXTS, (key >> 24) % CONTEXTS
        units, starts = np.unique(unit, return_index=True)
        met, which = np.unique((unit << 24) | at, return_inverse=True)  # a unit's words stand together
        firsts = np.searchsorted(met, units << 24)
        which = which - firsts[np.searchsorted(units, unit)]
        texts = [names[i] for i in (met & ((1 << 24) - 1)).tolist()]
        words = [b"\n".join(texts[a:b]) for a, b in itertools.pairwise([*firsts.tolist(), len(texts)])]
        data = [_packed(one[a:b], which[a:b], n[a:b]) for a, b in itertools.pairwise([*starts.tolist(), len(n)])]
        return pa.RecordBatch.from_arrays([pa.array(units), pa.array(np.ones(len(units), np.int32)), pa.array(words, pa.binary()), pa.array(data, pa.binary())], schema=_UNITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, part, size = defaultdict(itertools.count().__next__), [], [], 0
        for batch in batches:
            for text, h in zip(texts_of(batch), batch.column("h").to_pylist(), strict=True):
                tokens = [*words_in(text), END.encode()]
                for k in range(0, len(tokens), _CHUNK):
                    some = tokens[k : k + _CHUNK]
                    if k:  # a further chunk of a very long text begins with the token before it, which is context alone
                        some = [*tokens[k - 1 : k], *some]
                    ids.append(np.fromiter(map(words.__getitem__, some), np.int32, len(some)))
                    part.append(np.full(len(some), h % (1 << 16), np.int32))
                    if k:
                        part[-1][0] = -1
                    size += len(some)
                    if size >= _CHUNK:
                        yield counted(words, ids, part)
                        words, ids, part, size = defaultdict(itertools.count().__next__), [], [], 0
        if size:
            yield counted(words, ids, part)

    hashed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)).alias("h"), "text")
    return map_batches(hashed, freeing(count), UNITS, size=_BATCH_BYTES)


#: Words stand between line feeds, which no word holds; numbers are bytes. Arrays would take two or three times the memory in Spark's rows and Arrow's.
UNITS = "unit long, kind int, words binary, data binary"
_UNITS = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("words", pa.binary()), ("data", pa.binary())])


def _packed(ctx: np.ndarray, which: np.ndarray, n: np.ndarray) -> bytes:
    """Counts of (context, word) of a chunk, ten bytes each."""
    return ctx.astype("<u2").tobytes() + which.astype("<u4").tobytes() + n.astype("<u4").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = len(data) // 10
    return np.frombuffer(data, "<u2", m), np.frombuffer(data, "<u4", m, 2 * m), np.frombuffer(data, "<u4", m, 6 * m)


def _split(texts: list[bytes]) -> pa.Array:
    """The words of some rows, one after another."""
    if not texts:
        return pa.array([], pa.string())
    return pc.split_pattern(pa.array([b"\n".join(texts)], pa.binary()).cast(pa.string()), "\n").values


def _row(schema: pa.Schema, values: list) -> pa.RecordBatch:
    """A batch of one row; lists from arrays as they are."""
    columns = []
    for f, x in zip(schema, values, strict=True):
        if pa.types.is_list(f.type):
            x = x.cast(f.type.value_type) if isinstance(x, pa.Array) else pa.array(x, f.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x))
        else:
            columns.append(pa.array([x], f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _vocabularies(model: Model, counts: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """unit, kind 0, words and data: the words of every bucket with their counts, for each of its units."""
    classed = [w.decode("utf-8", "surrogatepass") for w, i in model.words.items() if 1 <= i <= CLASS_WORDS]
    rest = counts.where((F.col("word") != END) & ~F.col("word").isin(classed)) if classed else counts.where(F.col("word") != END)
    many = {b: -(-n // UNIT_TOKENS) for b, n in sizes.items() if n > UNIT_TOKENS}
    last = F.lit(0)
    for bucket, n in many.items():
        last = F.when(F.col("bucket") == bucket, n - 1).otherwise(last)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column("unit").to_numpy()
            order = np.argsort(unit, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(unit[order])) + 1, len(order)) if len(order) else []
            begin = 0
            for end in ends:
                some = batch.take(pa.array(order[begin:end]))
                yield _row(_UNITS, [int(unit[order[begin]]), 0, "\n".join(some.column("word").to_pylist()).encode(), some.column("c").to_numpy().tobytes()])
                begin = end

    each = rest.select("bucket", F.explode(F.sequence(F.lit(0), last)).alias("part"), "word", "c").select((F.col("bucket").cast("long") * (1 << 16) + F.col("part")).alias("unit"), "word", "c")
    return map_batches(each, freeing(pack), UNITS, rows=1 << 14)


BUCKET_ROWS = "bucket int, share double, words array<string>, c array<long>, e binary, bias binary, contexts binary, z binary"
_BUCKET_ROWS = pa.schema([("bucket", pa.int32()), ("share", pa.float64()), ("words", pa.list_(pa.string())), ("c", pa.list_(pa.int64())), ("e", pa.binary()), ("bias", pa.binary()), ("contexts", pa.binary()), ("z", pa.binary())])


def _learn_unit(unit: int, c: np.ndarray, ctx: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Embeddings, biases and contexts of a bucket from the counts of a unit. Words are in order, so the draws are those of any partitioning."""
    rng = np.random.default_rng([SEED, unit])
    noise = (c + 1.0) / (c + 1.0).sum()
    e, s, b = np.zeros((len(c), INNER), np.float32), np.random.default_rng([SEED, unit >> 16]).normal(0, 0.3, (CONTEXTS, INNER)).astype(np.float32), np.log(noise).astype(np.float32)
    sums = [np.full_like(x, 1e-3) for x in (e, s, b)]
    log_noise, cumulative = np.log(NOISE * noise).astype(np.float32), np.cumsum(noise)
    order = rng.permutation(len(n))
    for at in range(0, len(order), BATCH):
        pick = order[at : at + BATCH]
        u, w, weight = ctx[pick], word[pick], (n[pick] / n[pick].sum()).astype(np.float32)
        drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), len(c) - 1)
        h, ew, en = s[u], e[w], e[drawn]
        up = (1 - _sigmoid((h * ew).sum(1) + b[w] - log_noise[w])) * weight
        down = -_sigmoid(h @ en.T + (b - log_noise)[drawn]) * weight[:, None]
        rows, back = np.unique(np.concatenate([w, drawn]), return_inverse=True)
        de = _scatter(back, np.concatenate([up[:, None] * h, down.T @ h]), len(rows))
        db = np.bincount(back, np.concatenate([up, down.sum(0)]), len(rows)).astype(np.float32)
        ds = _scatter(u, up[:, None] * ew + down @ en, CONTEXTS)
        for x, g, d, some in ((e, sums[0], de, rows), (b, sums[2], db, rows), (s, sums[1], ds, slice(None))):
            g[some] += d * d
            x[some] += RATE * d / np.sqrt(g[some])
    return [e, b, s], int(n.sum())


def inner_softmax(model: Model, docs: DataFrame, counts: DataFrame) -> DataFrame:
    """A stored row a bucket: the share of what training has not seen, its words with counts, embeddings and biases, contexts and normalisers."""
    known = counts.where((F.col("word") != END)).groupBy("bucket").agg(F.sum("c").alias("n"))
    sizes = {r.bucket: r.n for r in known.collect()}  # a row a bucket
    rows = _vocabularies(model, counts, sizes).unionByName(_units(model, docs, sizes))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
        unit, vocabulary, pairs = None, [], []
        for batch in batches:
            for i in range(len(batch)):
                now = batch.column("unit")[i].as_py()
                if unit is not None and now != unit:
                    yield unit, vocabulary, pairs
                    vocabulary, pairs = [], []
                unit = now
                row = [batch.column(c)[i].as_py() for c in ("words", "data")]
                (pairs if batch.column("kind")[i].as_py() else vocabulary).append(row)
        if unit is not None:
            yield unit, vocabulary, pairs

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, vocabulary, pairs in gather(batches):
            if not vocabulary:
                continue
            names, c = _split([v[0] for v in vocabulary]), np.concatenate([np.frombuffer(v[1], np.int64) for v in vocabulary])
            order = pc.sort_indices(names.cast(pa.binary()))  # the order of bytes, however the rows lay
            names, c = names.take(order), c[order.to_numpy()]
            place = pc.index_in(_split([p[0] for p in pairs]), value_set=names).to_numpy().astype(np.int64)  # a training word is in the vocabulary
            starts = np.cumsum([0, *[p[0].count(b"\n") + 1 for p in pairs]])
            counted = [_unpacked(p[1]) for p in pairs]
            keys = [ctx.astype(np.int64) * len(names) + place[starts[i] + which] for i, (ctx, which, _) in enumerate(counted)]
            key, back = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            n = np.bincount(back, np.concatenate([np.zeros(0), *[x[2] for x in counted]]), len(key))
            (e, b, s), tokens = _learn_unit(unit, c, *np.divmod(key, len(names)), n)
            fixed = [np.rint(x.astype(np.float64) * (1 << 30)).astype(np.int64) * tokens for x in (e, b, s)]
            yield _row(_PARTS, [unit >> 16, names, c, tokens, *[x.tobytes() for x in fixed]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[dict]] = []
        for batch in batches:
            for i in range(len(batch)):
                row = {x: batch.column(x)[i] for x in batch.schema.names}
                if held and held[0]["bucket"].as_py() != row["bucket"].as_py():
                    yield _bucket_row(held)
                    held = []
                held.append(row)
        if held:
            yield _bucket_row(held)

    parts = rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(freeing(learn), PARTS)
    return materialise(parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(freeing(merge), BUCKET_ROWS), "lm-buckets")


PARTS = "bucket int, words array<string>, c array<long>, tokens long, e binary, b binary, s binary"
_PARTS = pa.schema([("bucket", pa.int32()), ("words", pa.list_(pa.string())), ("c", pa.list_(pa.int64())), ("tokens", pa.int64()), ("e", pa.binary()), ("b", pa.binary()), ("s", pa.binary())])


def _bucket_row(parts: list[dict]) -> pa.RecordBatch:
    """The average of a bucket's units by their tokens, in whole numbers, and the normaliser of every context."""
    tokens = sum(p["tokens"].as_py() for p in parts)
    mean = [sum(np.frombuffer(p[x].as_py(), np.int64) for p in parts) / (max(1, tokens) * float(1 << 30)) for x in "ebs"]
    names, c = parts[0]["words"].values, parts[0]["c"].values.to_numpy()
    e, b, s = mean[0].reshape(-1, INNER).astype(np.float32), mean[1].astype(np.float32), mean[2].reshape(-1, INNER).astype(np.float32)
    if not tokens:
        b = np.log((c + 1.0) / (c + 1.0).sum()).astype(np.float32)
    z = np.zeros(CONTEXTS)
    for at in range(0, len(c), 4096):
        z += np.exp((s @ e[at : at + 4096].T + b[at : at + 4096]).astype(np.float64)).sum(1)
    return _row(_BUCKET_ROWS, [parts[0]["bucket"].as_py(), 1 / float((c + 1).sum() + 1), names, c, e.tobytes(), b.tobytes(), s.tobytes(), np.log(z).astype(np.float32).tobytes()])


def bucket_words(buckets: DataFrame) -> DataFrame:
    """word, c, e (numbers) and bias of all words of the buckets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                e = np.frombuffer(batch.column("e")[i].as_py(), np.float32)
                bias, words, c = np.frombuffer(batch.column("bias")[i].as_py(), np.float32), batch.column("words")[i].values, batch.column("c")[i].values
                ends = pa.array(np.arange(len(bias) + 1) * INNER, pa.int32())
                whole = pa.RecordBatch.from_arrays([words, c, pa.ListArray.from_arrays(ends, pa.array(e)), pa.array(bias)], ["word", "c", "e", "bias"])
                for at in range(0, len(whole), 8192):
                    yield whole.slice(at, 8192)

    return buckets.select("words", "c", "e", "bias").mapInArrow(freeing(rows), "word string, c long, e array<float>, bias float")


def with_words(model: Model, buckets: DataFrame) -> Model:
    """The model with the contexts of all buckets, and with the embeddings of the words of its dictionary; nothing else reaches the driver."""
    model.inner, model.inner_z = np.zeros((BUCKETS + 1, CONTEXTS, INNER), np.float32), np.zeros((BUCKETS + 1, CONTEXTS), np.float32)
    for r in buckets.select("bucket", "share", "contexts", "z").collect():  # a row a bucket
        model.inner[r.bucket] = np.frombuffer(r.contexts, np.float32).reshape(CONTEXTS, INNER)
        model.inner_z[r.bucket] = np.frombuffer(r.z, np.float32)
        model.bucket_logs[r.bucket] = math.log(r.share)
    model.words_e, model.words_c = np.zeros((len(model.classes), INNER), np.float32), np.zeros(len(model.classes), np.float32)
    least = model.least
    if least is not None:
        held = bucket_words(buckets).where((F.octet_length("word") <= LONGEST) & (F.col("c") >= least)).toArrow()
        at = np.fromiter((model.words.get(w.encode("utf-8", "surrogatepass"), -1) for w in held.column("word").to_pylist()), np.int64, len(held))
        e = held.column("e").combine_chunks()
        e = (e.values if len(e) else pa.array([], pa.float32())).to_numpy().reshape(-1, INNER)
        model.words_e[at[at >= 0]], model.words_c[at[at >= 0]] = e[at >= 0], held.column("bias").to_numpy()[at >= 0]
    return model


def inner_log(model: Model, bucket: np.ndarray, ctx: np.ndarray, e: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Natural log-probabilities, inside their buckets, of words that training has seen."""
    seen = np.log1p(-np.exp(model.bucket_logs[bucket]))
    return seen + (model.inner[bucket, ctx] * e).sum(1) + bias - model.inner_z[bucket, ctx]


def score(model: Model, docs: DataFrame, counts: DataFrame, buckets: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, model.tables()))
    schema = "rid long, doc_id long, n_tokens long, n_known long, base double, lp double, rare array<struct<word:string,b:int,x:int>>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (a1, a2, z) = shared.value
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = texts_of(batch)
            if not texts:
                continue
            row, cls, starts, rare, at = sequences(m, texts)
            one, two = contexts(cls, starts)
            lp, near = (a1[one, cls] + a2[two, cls] - z[one, two]).astype(np.float64), narrow(one)
            inside = np.flatnonzero((cls >= 1) & (cls <= BUCKETS))
            b, x, w = cls[inside], near[inside], row[inside]
            seen = (w >= 0) & m.known[w]
            lp[inside] += np.where(seen, inner_log(m, b, x, m.words_e[w], m.words_c[w]), m.bucket_logs[b])  # what rarer words add comes from the join
            logs = np.where(row >= 0, m.log_counts[row], 0.0)
            known = np.add.reduceat(((row >= 0) & m.known[row]).astype(np.int64), starts)
            out = np.flatnonzero(row < 0)
            words = pa.StructArray.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in rare], pa.string()), pa.array(cls[out], pa.int32()), pa.array(near[out], pa.int32())], ["word", "b", "x"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=len(texts)))), pa.int32()), words)
            cols = [np.arange(rid, rid + len(texts)), None, np.diff([*starts, len(row)]), known, np.add.reduceat(logs, starts), np.add.reduceat(lp, starts) / math.log(10)]
            arrays = [batch.column("doc_id") if c is None else pa.array(c) for c in cols]
            yield pa.RecordBatch.from_arrays([*arrays, lists], ["rid", "doc_id", "n_tokens", "n_known", "base", "lp", "rare"])
            rid += len(texts)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, _ = shared.value
        for batch in batches:
            if not len(batch):
                continue
            b, x = batch.column("b").to_numpy(), batch.column("x").to_numpy()
            e = batch.column("e").flatten().to_numpy().reshape(-1, INNER)
            more = (inner_log(m, b, x, e, batch.column("bias").to_numpy()) - m.bucket_logs[b]) / math.log(10)
            base = np.log10(batch.column("c").to_numpy() + 1.0)
            rid, back = np.unique(batch.column("rid").to_numpy(), return_inverse=True)
            fixed = [np.rint(v * _FIXED).astype(np.int64) for v in (base, more)]  # sums of integers are the same in any order
            sums = [np.zeros(len(rid), np.int64) for _ in fixed]
            for s, v in zip(sums, fixed, strict=True):
                np.add.at(s, back, v)
            yield pa.RecordBatch.from_pydict({"rid": rid, "base": sums[0], "more": sums[1], "hits": np.bincount(back, minlength=len(rid))})

    scored = materialise(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), freeing(each), schema, size=_BATCH_BYTES), "lm-scored")
    exploded = scored.select("rid", F.inline("rare"))
    hits = exploded.join(bucket_words(buckets), "word").select("rid", "b", "x", "c", "e", "bias")
    found = map_batches(hits, freeing(joined), "rid long, base long, more long, hits long", rows=1 << 14).groupBy("rid").agg(F.sum("base").alias("more_base"), F.sum("more").alias("more"), F.sum("hits").alias("hits"))
    whole = scored.drop("rare").join(found, "rid", "left").na.fill(0, ["more_base", "more", "hits"])
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("hits")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") / _FIXED - F.col("n_tokens") * math.log10(model.tokens + model.distinct + 1)).alias("base_score"),
        (F.col("lp") + F.col("more") / _FIXED).alias("score"),
    )


_FIXED = float(1 << 30)


def op3(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model learnt from those outside the held-out fold; a null doc_id is in no fold and trains."""
    training = docs.where(F.coalesce(fold_of("doc_id", FOLDS) != HELD_OUT, F.lit(True)))
    counts = materialise(count_words(training), "lm-counts")
    model = train(prepare(counts), training)
    buckets = inner_softmax(model, training, counts)
    out = score(with_words(model, buckets), docs, counts, buckets)
    held = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
