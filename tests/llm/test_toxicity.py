import math
import re
import time
import zlib

import numpy as np
import pytest

from quern.llm import toxicity as tx
from tests.llm import cases

SF = "/root/testdata/sf0.1"


def auc(scores, ys):
    s, y = np.array(scores), np.array(ys)
    a, b = s[y == 1], s[y == 0]
    return (a[:, None] > b[None, :]).mean() + 0.5 * (a[:, None] == b[None, :]).mean()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = {r.doc_id: r for r in tx.op2(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [(out[r.doc_id], r.toxic) for r in labels.collect() if out[r.doc_id].held_out]
    assert auc([r.score for r, _ in held], [y for _, y in held]) > 0.9
    assert np.mean([r.predicted == y for r, y in held]) > 0.92


def test_odd_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = tx.op2(cases.odd(spark), labels).collect()
    assert len(out) == len(cases.ODD) and {r.score for r in out} == {0.0}
    both = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (3, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    out = tx.op2(cases.odd(spark), both).collect()
    assert len(out) == len(cases.ODD) and all(np.isfinite(r.score) for r in out)
    assert tx.op2(cases.empty(spark), both).count() == 0


def test_every_window_of_a_text_counts():
    """A long text scores as the highest of its windows, each scored alone."""
    texts = ["good calm words here " * 30, "vile awful slur words " * 30] * 6
    net = tx.fit(texts, [0, 1] * 6)
    reader = tx.Reader(net)
    words = ("good calm words here " * 40 + "vile awful slur words " * 9 + "good calm words here " * 40).split()
    whole = reader.scores([" ".join(words)])[0]
    parts = [tx.Reader(net).scores([" ".join(words[a : a + tx.WINDOW])])[0] for a in tx.windows_of(len(words))]
    assert whole == pytest.approx(max(parts), abs=1e-5)
    assert whole > reader.scores(["good calm words here " * 40])[0]


def test_windows_start_at_every_word():
    """Each run of WINDOW words counts, whatever its place: a text scores as the highest of all of them."""
    net = tx.Net({"a": 1}, np.zeros(2, np.float32), np.zeros(tx.TRIGRAMS, np.float32))
    net.start()
    rng = np.random.default_rng(3)
    for n in (5, 32, 33, 56, 150):
        words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n)]
        alone = [tx.Reader(net).scores([" ".join(words[a : a + 32])])[0] for a in range(max(1, n - 31))]
        assert tx.Reader(net).scores(["x", " ".join(words), "y " * 40])[1] == pytest.approx(max(alone), abs=1e-6)
    assert tx.windows_of(150) == list(range(119))


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = tx.Net({"a": 1}, np.zeros(2, np.float32), np.zeros(tx.TRIGRAMS, np.float32))
    net.start()
    x = rng.normal(0, 1, (6, 2 + tx.WORD_DIM + tx.CHAR_DIM))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at, mask = rng.integers(0, 6, (3, tx.WINDOW)), np.ones((3, tx.WINDOW))
    mask[1, 20:] = 0
    y, w = np.array([0.0, 1, 1]), np.array([1.0, 2, 1])

    def loss():
        p = 1 / (1 + np.exp(-net.logits(x, at, mask)))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    g, dx = net.gradients(x, at, mask, y, w)
    for k in ("wf", "ub", "cb", "wa", "va", "wo", "bo"):
        i = tuple(rng.integers(0, n) for n in net.p[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = loss()
        net.p[k][i] = old - 1e-3
        down = loss()
        net.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def slow_score(net, text):
    """A text's score by the definition: loops over windows, words and units, nothing shared between them."""
    words, sig = tx.words_in(text), lambda v: 1 / (1 + math.exp(-v))

    def vector(word):
        raw = f"<{word}>".encode()
        grams = [(raw[i] * 961 + raw[i + 1] * 31 + raw[i + 2]) * 2654435761 >> 8 & (tx.TRIGRAMS - 1) for i in range(len(raw) - 2)]
        mean = lambda table: [sum(float(table[g][j]) for g in grams) / len(grams) for j in range(tx.CHAR_DIM)]
        row = net.vocabulary.get(word, 0)
        return [float(net.word_odds[row]), sum(float(net.trigram_odds[g]) for g in grams) / len(grams), *map(float, net.p["word"][row]), *mean(net.p["char"])]

    def direction(xs, side):
        w, c, u, h, out = net.p[f"w{side}"], net.p[f"c{side}"], net.p[f"u{side}"], [0.0] * tx.HIDDEN, []
        n = tx.HIDDEN
        for x in xs if side == "f" else xs[::-1]:
            px = [sum(x[i] * float(w[i][j]) for i in range(len(x))) + float(c[j]) for j in range(3 * n)]
            hu = [sum(h[i] * float(u[i][j]) for i in range(n)) for j in range(3 * n)]
            z, r = [sig(px[j] + hu[j]) for j in range(n)], [sig(px[n + j] + hu[n + j]) for j in range(n)]
            new = [math.tanh(px[2 * n + j] + r[j] * hu[2 * n + j]) for j in range(n)]
            h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(n)]
            out.append(h)
        return out if side == "f" else out[::-1]

    best = -math.inf
    for a in range(max(1, len(words) - tx.WINDOW + 1)):
        xs = [vector(w) for w in words[a : a + tx.WINDOW]]
        hs = [f + b for f, b in zip(direction(xs, "f"), direction(xs, "b"), strict=True)]
        e = [sum(math.tanh(sum(h[i] * float(net.p["wa"][i][k]) for i in range(len(h)))) * float(net.p["va"][k]) for k in range(tx.HIDDEN)) for h in hs]
        alpha = [math.exp(v - max(e)) for v in e]
        pooled = [sum(w * h[i] for w, h in zip(alpha, hs, strict=True)) / sum(alpha) for i in range(2 * tx.HIDDEN)]
        best = max(best, sum(p * float(o) for p, o in zip(pooled, net.p["wo"], strict=True)) + float(net.p["bo"][0]))
    return sig(best)


def test_scores_by_brute_force():
    texts = ["good calm words here again " * 12, "vile awful slur words " * 12] * 6
    net = tx.fit(texts, [0, 1] * 6)
    for text in ("good", "vile slur", "calm words été here " * 11, "unknown things with vile awful words in them " * 6):
        assert tx.Reader(net).scores([text])[0] == pytest.approx(slow_score(net, text), abs=1e-5)


def test_held_out_rows_are_recomputed_and_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    flipped = labels.withColumn("toxic", tx.F.when(tx.fold_of("doc_id", 5) == 0, 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")).cast("int"))
    a, b = (sorted((r.doc_id, r.held_out, round(r.score, 7)) for r in tx.op2(docs, x).collect()) for x in (labels, flipped))
    assert a == b
    assert all(held == (zlib.crc32(str(d).encode()) % 5 == 0) for d, held, _ in a)


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(tx, "SAMPLE", 4)
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(60) for k in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, toxic int")
    texts, y = tx.sample(docs, labels)
    assert sum(y) <= 4 and len(y) - sum(y) <= 8 and len(set(texts)) == len(texts) and all(t.endswith(" 0") for t in texts)


def plain_slide(net, x):
    """The logits of all windows of a run in numpy, step by step."""
    b, both = len(x) - tx.WINDOW + 1, 2 * tx.HIDDEN
    halves = np.repeat(np.float32([0.5, 1]), [both, tx.HIDDEN])[:, None]
    hidden, hu = np.empty((tx.WINDOW, both, b), np.float32), np.empty((3 * tx.HIDDEN, b), np.float32)
    for i, side in enumerate(("f", "b")):
        px = halves * (net.p[f"w{side}"].T @ x.T + net.p[f"c{side}"][:, None])
        u, h = np.ascontiguousarray(halves * net.p[f"u{side}"].T), np.zeros((tx.HIDDEN, b), np.float32)
        for k in range(tx.WINDOW) if side == "f" else range(tx.WINDOW - 1, -1, -1):
            np.matmul(u, h, out=hu)
            g = hu[:both]
            g += px[:both, k : k + b]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            n = hu[both:]
            n *= g[tx.HIDDEN :]
            n += px[both:, k : k + b]
            np.tanh(n, out=n)
            h -= n
            h *= g[: tx.HIDDEN]
            h += n
            hidden[k, i * tx.HIDDEN : (i + 1) * tx.HIDDEN] = h
    e = np.matmul(net.p["va"], np.tanh(np.matmul(np.ascontiguousarray(net.p["wa"].T), hidden)))
    e = np.exp(e - e.max(0))
    return (e * np.matmul(net.p["wo"], hidden)).sum(0) / e.sum(0) + net.p["bo"]


def test_windows_are_read_in_less_time_than_in_plain_numpy():
    net = tx.Net({"a": 1}, np.zeros(2, np.float32), np.zeros(tx.TRIGRAMS, np.float32))
    net.start()
    x = np.random.default_rng(5).normal(0, 1, (4096, 2 + tx.WORD_DIM + tx.CHAR_DIM)).astype(np.float32)
    slide, spent = tx.Slide(net), ([], [])
    assert np.abs(slide(x) - plain_slide(net, x)).max() < 1e-5
    for _ in range(7):
        for took, read in zip(spent, (slide, lambda v: plain_slide(net, v)), strict=True):
            began = time.process_time()
            read(x)
            took.append(time.process_time() - began)
    assert min(spent[0]) < 0.75 * min(spent[1])
    assert slide(x[: tx.WINDOW]).shape == (1,)


def test_words_are_runs_of_word_characters():
    for text in ("", "Aa_1 b-c", "İstanbul ǅ ß²½ a\u0085b c d e naïve—x", "\x1ca\x1f\x00b", "日本語、テ", "\ud800x ýz"):
        assert tx.words_in(text) == re.findall(r"\w+", text.lower())


def test_a_full_cache_of_words_begins_anew(monkeypatch):
    net = tx.fit(["good calm words here " * 12, "vile awful slur words " * 12] * 6, [0, 1] * 6)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) + " vile slur" for i in range(6)]
    want = [tx.Reader(net).scores([t])[0] for t in texts]
    monkeypatch.setattr(tx, "_CACHE", 60)
    reader = tx.Reader(net)
    assert [reader.scores([t])[0] for t in [*texts, *texts]] == pytest.approx(want * 2, abs=1e-6)
    assert reader.scores(texts) == pytest.approx(want, abs=1e-6)
