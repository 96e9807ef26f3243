"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, learnt in numpy.

A word's input holds a learnt vector of the word (if training saw it often enough), the mean of learnt vectors of its character
trigrams, and two log-odds that say how much more often toxic training documents hold the word and its trigrams. The network
reads every window of WINDOW words, one from each word on, over the whole text; a document's score is that of its most toxic
window. Training picks each document's most toxic window, of all of them, anew every few epochs and learns from it.

The model is fitted on a bounded sample of labelled rows outside the held-out fold: at most SAMPLE of label 1 and 2 * SAMPLE of
label 0, those of the least hash of doc_id; the vocabulary of word vectors is bounded by MOST_WORDS of the words that three of these
rows hold (other words still have their trigrams). Neither labels, lang, source nor doc_id enter a score.

Defined results: null counts as an empty text, which is one window of padding and is scored like any other. Repeated rows score
alike. If a doc_id has both labels it counts with both; of
several rows of one doc_id the sample holds the least text. Without labels of both kinds every score is the share of
label 1 (0 without any). Very long texts are read a few thousand windows at a time. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fold_of, map_batches, texts_of
from quern.llm.onnx_graph import constant, node, session

FOLDS, HELD_OUT = 5, 0
SAMPLE = 1000
WINDOW = 32
HIDDEN = 8
WORD_DIM, CHAR_DIM = 6, 6
TRIGRAMS = 4096
MOST_WORDS = 20_000
EPOCHS, RESELECT = 16, (0, 2, 5, 9)
BATCH = 96
RATE = 0.02
SEED = 7
_CHUNK = 6144
_CACHE = 250_000
_WORD = re.compile(r"\w")
_SPACED = bytes(c if c > 127 or _WORD.match(chr(c)) else 32 for c in range(256))  # ASCII beside words becomes blanks


def words_in(text: str) -> list[str]:
    r"""The runs of \w of a text in lower case."""
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not c.isalnum():  # \w beyond ASCII
                text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).decode("utf-8", "surrogatepass").split()


def trigrams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the bytes of words, their ends marked, one word after another, and where each word's begin."""
    raw = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    sizes = np.fromiter((len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
    padded = np.append(raw, [0, 0])
    hashed = (padded[:-2] * 961 + padded[1:-1] * 31 + padded[2:]) * 2654435761 >> 8 & (TRIGRAMS - 1)
    ends = np.cumsum(sizes + 2)
    inside = np.ones(len(raw), bool)  # the last two bytes of a word start none
    inside[ends - 1] = inside[ends - 2] = False
    return hashed[inside].astype(np.int32), np.cumsum(sizes) - sizes


def windows_of(n: int) -> list[int]:
    """First words of the windows over n words."""
    return list(range(max(1, n - WINDOW + 1)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of rows by index."""
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], axis=1).astype(np.float32)


@dataclass
class Net:
    """Parameters by name, and the fixed log-odds inputs."""

    vocabulary: dict[str, int]
    word_odds: np.ndarray
    trigram_odds: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    def start(self) -> None:
        rng, d = np.random.default_rng(SEED), 2 + WORD_DIM + CHAR_DIM
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": normal(0.1, len(self.vocabulary) + 1, WORD_DIM), "char": normal(0.1, TRIGRAMS, CHAR_DIM)}
        for side in ("f", "b"):
            self.p |= {f"w{side}": normal(0.3, d, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32), f"u{side}": normal(0.3, HIDDEN, 3 * HIDDEN)}
        self.p |= {"wa": normal(0.3, 2 * HIDDEN, HIDDEN), "va": normal(0.3, HIDDEN), "wo": normal(0.3, 2 * HIDDEN), "bo": np.full(1, -1.0, np.float32)}

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of words."""
        return self.mix(np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int32, len(words)), *trigrams_of(words))

    def mix(self, rows: np.ndarray, tri: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(starts, len(tri)))[:, None]
        chars = np.add.reduceat(np.hstack([self.trigram_odds[:, None], self.p["char"]])[tri], starts) / n
        return np.hstack([self.word_odds[rows][:, None], chars[:, :1], self.p["word"][rows], chars[:, 1:]]).astype(np.float32)

    def recur(self, px: np.ndarray, at: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (windows, WINDOW, HIDDEN) of one direction. px: projected inputs by row; at: rows of each window."""
        u, (b, t) = self.p[f"u{side}"], at.shape
        h, out = np.zeros((b, HIDDEN), np.float32), np.zeros((b, t, HIDDEN), np.float32)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            x, hu, m = px[at[:, k]], h @ u, mask[:, k : k + 1]
            g = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((k, h, hu[:, 2 * HIDDEN :], z, r, n, m))
            h = h + m * (new - h)
            out[:, k] = h
        return out

    def logits(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit per window. x: inputs of distinct words, the last being padding."""
        parts = []
        for side in ("f", "b"):
            saved = [] if keep is not None else None
            parts.append(self.recur(x @ self.p[f"w{side}"] + self.p[f"c{side}"], at, mask, side, saved))
            if keep is not None:
                keep[side] = saved
        h = np.concatenate(parts, axis=2)
        s = np.tanh(h @ self.p["wa"])
        e = s @ self.p["va"] + (mask - 1) * 30
        e = np.exp(e - e.max(1, keepdims=True))
        alpha = e / e.sum(1, keepdims=True)
        pooled = (alpha[:, :, None] * h).sum(1)
        if keep is not None:
            keep |= {"h": h, "s": s, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"]

    def window_logits(self, table: np.ndarray, rows: list[np.ndarray], slide: Slide) -> list[np.ndarray]:
        """The logits of all windows of each text, given as rows of a table of input vectors, whose row 0 is padding. slide: made of this net."""
        out: list[np.ndarray] = [np.zeros(0)] * len(rows)
        short = [i for i, r in enumerate(rows) if len(r) < WINDOW]
        for a in range(0, len(short), _CHUNK):
            at = np.zeros((len(short[a : a + _CHUNK]), WINDOW), np.int32)
            for line, i in zip(at, short[a : a + _CHUNK], strict=True):
                line[: len(rows[i])] = rows[i]
            ids, where = np.unique(at, return_inverse=True)
            found = self.logits(table[ids], where.reshape(-1, WINDOW), (at > 0).astype(np.float32))
            for k, i in enumerate(short[a : a + _CHUNK]):
                out[i] = found[k : k + 1]
        long = [i for i, r in enumerate(rows) if len(r) >= WINDOW]
        if long:  # all in one run; windows over the end of a text are left out afterwards
            run = np.concatenate([rows[i] for i in long])
            found = np.concatenate([slide(table[run[a : a + _CHUNK + WINDOW - 1]]) for a in range(0, len(run) - WINDOW + 1, _CHUNK)])
            first = 0
            for i in long:
                out[i] = found[first : first + len(rows[i]) - WINDOW + 1]
                first += len(rows[i])
        return out

    def gradients(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted cross-entropy by parameter, and by input vector."""
        keep: dict = {}
        d = ((_sigmoid(self.logits(x, at, mask, keep)) - y) * weight / len(y)).astype(np.float32)
        h, s, alpha = keep["h"], keep["s"], keep["alpha"]
        g = {"wo": keep["pooled"].T @ d, "bo": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["wo"]
        da = (h * dp[:, None, :]).sum(2)
        de = alpha * (da - (alpha * da).sum(1, keepdims=True))
        ds = de[:, :, None] * self.p["va"] * (1 - s * s)
        g["va"] = (de[:, :, None] * s).sum((0, 1))
        g["wa"] = np.einsum("bth,btk->hk", h, ds)
        dh = alpha[:, :, None] * dp[:, None, :] + ds @ self.p["wa"].T
        dx = np.zeros_like(x)
        for i, side in enumerate(("f", "b")):
            own, u = dh[:, :, i * HIDDEN : (i + 1) * HIDDEN], self.p[f"u{side}"]
            du, dpx, back = np.zeros_like(u), np.zeros((*at.shape, 3 * HIDDEN), np.float32), np.zeros((len(at), HIDDEN), np.float32)
            for k, before, hun, z, r, n, m in reversed(keep[side]):
                total = own[:, k] + back
                dnew = total * m
                dz, dn = dnew * (before - n) * z * (1 - z), dnew * (1 - z) * (1 - n * n)
                dr = dn * hun * r * (1 - r)
                dgate = np.hstack([dz, dr, dn * r])
                du += before.T @ dgate
                dpx[:, k] = np.hstack([dz, dr, dn])
                back = total * (1 - m) + dnew * z + dgate @ u.T
            dpx = _scatter(at.ravel(), dpx.reshape(-1, 3 * HIDDEN), len(x))
            g |= {f"u{side}": du, f"w{side}": x.T @ dpx, f"c{side}": dpx.sum(0)}
            dx += dpx @ self.p[f"w{side}"].T
        return g, dx


class Slide:
    """The logits of all windows of a run of input vectors, as the network is now: what `logits` gives, without padding.

    A matrix has a row for each window. The inputs of a step are the same rows of the run for all windows, one further at each step.
    """

    def __init__(self, net: Net):
        p, none = net.p, np.zeros(1, np.float32)
        sides, gates = {"f": range(WINDOW), "b": range(WINDOW - 1, -1, -1)}, {g: slice(i * HIDDEN, (i + 1) * HIDDEN) for i, g in enumerate("zrn")}
        self.bo, self.project, constants, nodes, inputs = p["bo"], {}, [], [], {}
        for i, (side, steps) in enumerate(sides.items()):
            own, h = slice(i * HIDDEN, (i + 1) * HIDDEN), ""
            constants.append(constant(f"{side}pool", np.vstack([p["wa"][own].T, p["wo"][None, own]])))
            for g, s in gates.items():
                self.project[side + g] = np.ascontiguousarray(p[f"w{side}"][:, s]), p[f"c{side}"][s]
                constants.append(constant(f"{side}u{g}", p[f"u{side}"][:, s]))
            for k in steps:
                at = f"{side}{k}"
                inputs |= {f"{side}{g}{k}": (side + g, k) for g in gates if h or g != "r"}
                z, r, n, hu, m, q, d, c = (f"{at}{x}" for x in ("gate", "reset", "new", "hu", "m", "q", "d", "c"))
                if h:
                    nodes += [node("FusedGemm", [h, f"{side}ur", f"{side}r{k}"], r, "com.microsoft", activation="Sigmoid"), node("MatMul", [h, f"{side}un"], hu), node("Mul", [hu, r], m)]
                    nodes += [node("Add", [m, f"{side}n{k}"], q), node("Tanh", [q], n), node("FusedGemm", [h, f"{side}uz", f"{side}z{k}"], z, "com.microsoft", activation="Sigmoid")]
                    nodes += [node("Sub", [h, n], d), node("Mul", [d, z], c), node("Add", [c, n], f"{at}h")]
                else:  # the state before is zero
                    nodes += [node("Sigmoid", [f"{side}z{k}"], z), node("Tanh", [f"{side}n{k}"], n), node("Mul", [n, z], c), node("Sub", [n, c], f"{at}h")]
                h = f"{at}h"
                pooled = ["fpool", h] if side == "f" else ["bpool", h, f"f{k}pooled"]  # what attention and output take of both directions
                nodes.append(node("Gemm", pooled, f"{at}pooled", transB=1))
        constants += [constant("va", np.append(p["va"], none)[None]), constant("last", np.array([HIDDEN])), constant("end", np.array([HIDDEN + 1])), constant("axis", np.array([0]))]
        for k in range(WINDOW):
            nodes += [node("Tanh", [f"b{k}pooled"], f"s{k}"), node("MatMul", ["va", f"s{k}"], f"e{k}"), node("Slice", [f"b{k}pooled", "last", "end", "axis"], f"o{k}")]
        nodes += [node("Concat", [f"{x}{k}" for k in range(WINDOW)], x, axis=0) for x in "eo"]
        self.inputs, self.run = inputs, session(nodes, constants, dict.fromkeys(inputs, HIDDEN), ["e", "o"]).run

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b = len(x) - WINDOW + 1
        projected = {name: x @ w + c for name, (w, c) in self.project.items()}
        e, out = self.run(None, {name: projected[of][k : k + b] for name, (of, k) in self.inputs.items()})
        e = np.exp(e - e.max(0))
        return (e * out).sum(0) / e.sum(0) + self.bo


class Reader:
    """Scores texts, remembering the inputs of distinct words in a bounded cache."""

    def __init__(self, net: Net):
        self.slide = Slide(net)
        self.net, self.rows, self.table, self.n = net, {}, np.zeros((_CACHE + 1, net.p["wf"].shape[0]), np.float32), 1

    def _rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        for _ in range(2):
            new: dict[str, int] = {}
            found = [np.fromiter(map(self.rows.get, words, repeat(0)), np.int32, len(words)) for words in texts]
            for words, at in zip(texts, found, strict=True):
                for k in np.flatnonzero(at == 0).tolist():
                    at[k] = self.n + new.setdefault(words[k], len(new))
            if self.n + len(new) <= len(self.table):
                break
            self.rows, self.n = {}, 1  # begin anew
            size = 1 + sum(map(len, texts))
            if size > len(self.table):
                self.table = np.zeros((size, self.table.shape[1]), np.float32)
        words = list(new)
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            self.table[self.n + a : self.n + a + len(part)] = self.net.inputs(part)
        self.rows.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.n += len(words)
        return found

    def scores(self, texts: list[str]) -> list[float]:
        """The score of each whole text: its most toxic window's."""
        rows = self._rows([words_in(t) for t in texts])  # may replace the table
        found = self.net.window_logits(self.table, rows, self.slide)
        return _sigmoid(np.array([x.max() for x in found])).tolist()


def _of_highest(scores: np.ndarray) -> int:
    """The first word of the window that holds the highest score of a word, that word as near its middle as can be."""
    return min(max(0, int(scores.argmax()) - WINDOW // 2), max(0, len(scores) - WINDOW))


def _log_odds(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    return np.clip(np.log((ones + 0.5) / (n1 + 1)) - np.log((zeros + 0.5) / (n0 + 1)), -3, 3).astype(np.float32) / 3


def fit(texts: list[str], y: list[int]) -> Net:
    """A network learnt from a bounded sample of labelled texts."""
    n1, n0 = sum(y), len(y) - sum(y)
    if not n1 or not n0:
        net = Net({}, np.zeros(1, np.float32), np.zeros(TRIGRAMS, np.float32), constant=n1 / len(y) if y else 0.0)
        net.start()
        return net
    words, seen, tri = [words_in(t) for t in texts], (Counter(), Counter()), np.zeros((2, TRIGRAMS))
    for ws, label in zip(words, y, strict=True):
        seen[label].update(set(ws))
        tri[label, np.unique(trigrams_of(list(set(ws)))[0])] += 1
    often = sorted((w for w, c in (seen[0] + seen[1]).items() if c >= 3), key=lambda w: (-seen[0][w] - seen[1][w], w))[:MOST_WORDS]
    net = Net({w: i + 1 for i, w in enumerate(often)}, np.zeros(0), _log_odds(tri[1], tri[0], n1, n0))
    net.word_odds = np.append(np.float32(0), _log_odds(np.array([seen[1][w] for w in often]), np.array([seen[0][w] for w in often]), n1, n0)).astype(np.float32)
    net.start()
    distinct = sorted({w for ws in words for w in ws})
    index = {w: i + 1 for i, w in enumerate(distinct)}
    rows = np.fromiter((net.vocabulary.get(w, 0) for w in distinct), np.int32, len(distinct))
    grams, starts = trigrams_of(distinct)
    counts = np.diff(np.append(starts, len(grams)))

    def inputs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of distinct words by number, 0 being padding; then word rows, trigrams and how many each has."""
        at = ids[ids > 0] - 1
        n = counts[at]
        first = np.cumsum(n) - n
        flat = grams[np.repeat(starts[at] - first, n) + np.arange(n.sum())]
        return np.vstack([np.zeros((len(ids) - len(at), 2 + WORD_DIM + CHAR_DIM), np.float32), net.mix(rows[at], flat, first)]), rows[at], flat, n

    texts_rows = [np.array([index[w] for w in ws], np.int32) for ws in words]
    padded = [np.append(r, np.zeros(max(0, WINDOW - len(r)), np.int32)) for r in texts_rows]
    labels, rng = np.array(y, np.float32), np.random.default_rng(SEED)
    balance = np.where(labels > 0, min(4.0, n0 / n1) ** 0.5, 1.0).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    turn = 0
    for epoch in range(EPOCHS):
        if epoch in RESELECT:
            x = inputs(np.arange(len(distinct) + 1))[0]
            if epoch == 0:  # nothing is learnt yet: start from the windows of the highest log-odds
                odds = x[:, :2].sum(1)
                chosen = [_of_highest(odds[r]) for r in padded]
            else:
                slide = Slide(net)
                chosen = [int(v.argmax()) for i in range(0, len(y), BATCH) for v in net.window_logits(x, texts_rows[i : i + BATCH], slide)]
            at = np.stack([r[k : k + WINDOW] for r, k in zip(padded, chosen, strict=True)])
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            ids, where = np.unique(at[pick], return_inverse=True)
            x, of, flat, n = inputs(ids)
            g, dx = net.gradients(x, where.reshape(-1, WINDOW), (at[pick] > 0).astype(np.float32), labels[pick], balance[pick])
            dx = dx[len(ids) - len(of) :]
            g["word"] = _scatter(of, dx[:, 2 : 2 + WORD_DIM], len(net.p["word"]))
            g["char"] = _scatter(flat, np.repeat(dx[:, 2 + WORD_DIM :] / n[:, None], n, axis=0), TRIGRAMS)
            turn += 1
            rate = RATE * (1 - epoch / EPOCHS) * math.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
            for k, d in g.items():
                m, v = moment[k]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                net.p[k] -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded training sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    known = known.where(fold_of("doc_id", FOLDS) != HELD_OUT)
    order = (F.xxhash64("doc_id"), "doc_id")
    least = known.where("y = 1").orderBy(*order).limit(SAMPLE).unionByName(known.where("y = 0").orderBy(*order).limit(2 * SAMPLE)).distinct()
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(least), "doc_id")  # at most 3 * SAMPLE ids
    rows = found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()  # a doc_id on many rows counts with its least text
    rows.sort(key=lambda r: (r.y, r.doc_id, r.text))
    return [r.text for r in rows], [r.y for r in rows]


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a network learnt from the sample."""
    net = fit(*sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            if len(batch):
                texts = texts_of(batch)
                found = np.array(reader.scores(texts) if net_constant is None else [net_constant] * len(texts), np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    net_constant = net.constant
    scored = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
