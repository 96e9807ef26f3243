import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quern.llm import language_model as lm
from tests.llm import cases


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    c = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = [(str(d), held(d), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 5)) for d, t in rows]
    out = lm.op3(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == sorted(want)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    return out


def test_base_and_gain(spark):
    out = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    unseen = [r for r in out if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) + 0.04 * abs(sum(r.base_score for r in unseen))


def test_rare_words_go_through_the_join(spark, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 20)
    monkeypatch.setattr(lm, "CLASS_WORDS", 8)
    monkeypatch.setattr(lm, "_FLUSH", 50)
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_odd_and_empty(spark):
    check(cases.odd(spark))
    assert lm.op3(cases.empty(spark)).count() == 0


def test_probabilities_are_normalised(spark):
    counts = spark.createDataFrame([("\n", 0, 3), ("a", 7, 5), ("b", 9, 2), ("cc", 9, 1)], "word string, bucket int, c long")
    model = lm.prepare(counts)
    rng = np.random.default_rng(1)
    model.r, model.q = (rng.normal(0, 1, x.shape).astype(np.float32) for x in (model.r, model.q))
    a1, a2, z = model.tables()
    for one, two in ((0, 0), (257, 9), (40, 258)):
        assert abs(np.exp((a1[one] + a2[two] - z[one, two]).astype(np.float64)).sum() - 1) < 1e-4
        direct = (model.r[one] @ model.m1 + model.r[two] @ model.m2) @ model.q.T + model.b
        assert abs(np.log(np.exp(direct.astype(np.float64)).sum()) - z[one, two]) < 1e-3


def test_every_word_of_the_training_texts_is_predicted_as_a_word(spark):
    """At each size: no token of the training folds is left to a share of its bucket, and inside every bucket probabilities sum to one."""
    for most in (40, 120, 200):
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") < most)
        counts = lm.materialise(lm.count_words(docs), "counts")
        model = lm.prepare(counts)
        buckets = lm.inner_softmax(model, docs, counts)
        lm.with_words(model, buckets)
        own = {r.word: r for r in lm.bucket_words(buckets).collect()}
        classed = {w.decode() for w, i in model.words.items() if i <= lm.CLASS_WORDS}
        assert {r.word for r in counts.collect()} == own.keys() | classed and not own.keys() & classed
        rows = {r.bucket: r for r in buckets.collect()}
        for b in list(rows)[:20]:
            n = len(rows[b].words)
            e, bias = np.frombuffer(rows[b].e, np.float32).reshape(n, lm.INNER), np.frombuffer(rows[b].bias, np.float32)
            assert np.abs(e).max() > 0
            for x in (0, 3, 70):
                logs = lm.inner_log(model, np.full(n, b), np.full(n, x), e, bias)
                assert abs(np.exp(logs).sum() + rows[b].share - 1) < 1e-4


def test_units_of_a_bucket_are_averaged(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(lm, "UNIT_TOKENS", 300)
    found = [sorted((r.doc_id, round(r.score, 9)) for r in lm.op3(docs.repartition(n)).collect()) for n in (1, 5)]
    assert found[0] == found[1]


def test_contexts_start_anew_with_each_text():
    one, two = lm.contexts(np.array([5, 6, 0, 7, 8, 0]), np.array([0, 3]))
    assert one.tolist() == [0, 5, 6, 0, 7, 8] and two.tolist() == [0, 0, 5, 0, 0, 7]


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [sorted((r.doc_id, round(r.score, 9), round(r.base_score, 9)) for r in lm.op3(docs.repartition(n)).collect()) for n in (1, 4, 8)]
    assert found[0] == found[1] == found[2]


def test_score_of_a_text_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "CLASS_WORDS", 12)
    monkeypatch.setattr(lm, "DICTIONARY", 60)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    training = docs.where(lm.fold_of("doc_id", lm.FOLDS) != lm.HELD_OUT)
    counts = lm.materialise(lm.count_words(training), "counts")
    model = lm.train(lm.prepare(counts), training)
    buckets = lm.inner_softmax(model, training, counts)
    lm.with_words(model, buckets)
    own = {r.word.encode(): r for r in lm.bucket_words(buckets).collect()}
    c = {r.word.encode(): r.c for r in counts.collect()}
    top = [r.word.encode() for r in lm.frequent(counts)[:12]]
    assert top == [w for w in sorted(c, key=lambda w: (-c[w], w)) if w != b"\n"][: len(top)] and len(top) > 5
    cls = lambda w: 0 if w == b"\n" else 256 + top.index(w) if w in top else 1 + zlib.crc32(w[-2:]) % 255
    narrow = lambda k: 0 if k == 0 else k - 255 + 64 if 255 < k <= 511 else 1 + k % 64
    inside = {}
    for w, r in own.items():
        inside.setdefault(cls(w), []).append(r)
    for r in lm.score(model, docs, counts, buckets).collect():
        text = next(x.text for x in docs.where(F.col("doc_id") == r.doc_id).collect()) if r.doc_id < 6 else None
        if text is None:
            continue
        one, two, total = 0, 0, 0.0
        for w in tokens(text):
            k = cls(w)
            logits = ((model.r[one] @ model.m1 + model.r[two] @ model.m2) @ model.q.T + model.b).astype(np.float64)
            total += (logits[k] - np.log(np.exp(logits).sum())) / math.log(10)
            if 1 <= k <= 255:
                others = inside.get(k, [])
                share = 1 / (sum(x.c + 1 for x in others) + 1)
                s = model.inner[k, narrow(one)].astype(float)
                z = sum(math.exp(float(np.dot(s, x.e)) + x.bias) for x in others)
                total += math.log10((1 - share) * math.exp(float(np.dot(s, own[w].e)) + own[w].bias) / z if w in own else share)
            one, two = k, one
        assert abs(total - r.score) < 1e-3 * max(1, abs(total))


def test_the_dictionary_is_bounded_and_takes_the_most_frequent(spark, monkeypatch):
    counts = spark.createDataFrame([("w%d" % i, 1, c) for i, c in enumerate([5000, 4999, 70, 70, 9, 1, 1, 1])] + [("\n", 0, 9)], "word string, bucket int, c long")
    for room, want in ((100, 8), (7, 5), (5, 5), (4, 4), (3, 2), (2, 2), (0, 0)):
        monkeypatch.setattr(lm, "DICTIONARY", room)
        assert [r.word for r in lm.frequent(counts)] == ["w%d" % i for i in range(want)]


def test_a_long_text_is_cut_into_rows_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 50)
    docs = spark.createDataFrame([(1, "a b " * 300), (3, "c d"), (4, None), (3, "c d")], "doc_id long, text string")
    counts = lm.materialise(lm.count_words(docs), "counts")
    rows = lm.shards(lm.prepare(counts), docs).collect()
    assert sum(len(r.tokens) // 2 for r in rows) == 601 + 3 + 1 + 3


def test_units_are_rows_of_bytes(spark):
    """What learns a bucket is shuffled as packed bytes, a few rows a chunk, and its counts are those of the texts."""
    docs = spark.createDataFrame([(1, "aé bé aé cé " * 5), (3, "bé, aé")], "doc_id long, text string")
    counts = lm.materialise(lm.count_words(docs), "counts")
    rows = lm._units(lm.prepare(counts), docs, {}).collect()
    assert {f.dataType.simpleString() for f in lm._units(lm.prepare(counts), docs, {}).schema[2:]} == {"binary"}
    classed = {w for w, i in lm.prepare(counts).words.items() if 1 <= i <= lm.CLASS_WORDS}
    assert not rows and len(classed) == 4  # all are words of a class
    model = lm.prepare(counts.where("false"))
    model.words, model.classes = {b"\n": 0}, np.zeros(2, np.int32)
    seen = Counter()
    for r in lm._units(model, docs, {}).collect():
        words = lm._split([bytes(r.words)]).to_pylist()
        for _, w, n in zip(*lm._unpacked(bytes(r.data)), strict=True):
            seen[words[w]] += int(n)
    assert seen == Counter({"aé": 11, "bé": 5, "cé": 5, "bé,": 1})


def test_a_worker_gives_back_what_it_has_freed():
    """What a function leaves free between pieces that stay is not kept until the next task."""
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20  # noqa: E731, SIM115
    stays = []

    def cluttered(batches):
        for batch in batches:
            held = [bytes(3000) for _ in range(100_000)]
            stays.extend(held[::100])  # the heap cannot shrink from its end
            peaks.append(resident())
            del held
            yield batch

    peaks, before = [], resident()
    assert list(lm.freeing(cluttered)(iter(["a batch"]))) == ["a batch"]
    assert peaks[0] > before + 200 and resident() < before + 100


def test_sigmoid_at_its_ends():
    x = np.float32([-200, -5, 0, 5, 200])
    assert np.allclose(lm._sigmoid(x), [0, 1 / (1 + math.exp(5)), 0.5, 1 / (1 + math.exp(-5)), 1], atol=1e-6)
