"""Subword encoding and decoding with a SentencePiece vocabulary, by shared-prefix Viterbi.

A text gets a leading space and is cut before each space and around each line end; spaces are marked with U+2581. No piece in
use crosses such a cut, so the best segmentation of a text is that of its marked words. The distinct new words of a batch are
sorted, which lays them out as a trie in depth-first order: each word keeps the forward scores of the prefix it shares with
the word before, and only the rest is computed. What no piece covers becomes the byte pieces of its UTF-8, also a literal
U+2581, so decoding gives every text back exactly.

The vocabulary file holds BPE merge ranks, not log-probabilities; a piece of rank r gets the Zipf-Mandelbrot
log-probability -ln(r + OFFSET), normalised over all pieces, and each byte piece BYTE_SCORE. Ties go to the longer last piece.

Defined results: null encodes to null and decodes to null; an empty text encodes to no ids. Repeated rows are coded one by one.
Texts and words of any length are whole; a word longer than CACHED_LENGTH is coded by itself and not remembered.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_batches

MARK = "▁"
OFFSET = 2.7
BYTE_SCORE = -30.0
CACHE_WORDS = 600_000
CACHED_LENGTH = 40
_WORD = re.compile(" [^ \n]*|\n|[^ \n]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces of a vocabulary with their scores, and a bounded cache of encoded words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        ids = range(n)
        self.strings = [model.id_to_piece(i) for i in ids]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
        usable = [i for i in ids if i not in special and MARK not in self.strings[i][1:]]
        order = sorted(usable, key=lambda i: (-model.get_score(i), i))
        total = math.log(sum(1 / (r + OFFSET) for r in range(len(order))))
        self.pieces = {self.strings[i]: (-math.log(r + OFFSET) - total, i) for r, i in enumerate(order)}
        self.longest = max(map(len, self.pieces), default=1)
        self.known: dict[str, bytes] = {}
        self.bytes_of = [bytes([self.byte_ids.index(i)]) if i in set(self.byte_ids) else s.replace(MARK, " ").encode() for i, s in enumerate(self.strings)]
        # a piece ending in one of these is only ever followed by what extends it
        self.starts: dict[str, int] = {}
        for p in self.pieces:
            self.starts[p[0]] = max(self.starts.get(p[0], 0), len(p))

    def _units(self, word: str) -> str:
        """The marked form of a word: the leading space as U+2581, which elsewhere is a private stand-in for the literal one."""
        return MARK + word[1:].replace(MARK, "\udcff") if word[0] == " " else word.replace(MARK, "\udcff")

    def learn(self, words: set[str], into: dict[str, bytes]) -> None:
        """Encode words in sorted order, reusing the forward scores of the prefix each shares with the one before."""
        pieces, longest, starts = self.pieces, self.longest, self.starts
        score, back = [0.0], [(0, -1)]  # for each prefix: its best score, and the last piece's start and id
        before = ""
        for marked, word in sorted((self._units(w), w) for w in words):
            shared = len(commonprefix((before, marked)))
            del score[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                best, link = -math.inf, (end - 1, -1)
                for start in range(max(0, end - longest), end):
                    if end - start <= starts.get(marked[start], 0):
                        hit = pieces.get(marked[start:end])
                        if hit and score[start] + hit[0] > best:
                            best, link = score[start] + hit[0], (start, hit[1])
                if best == -math.inf:
                    best = score[end - 1] + BYTE_SCORE * len(self._utf8(marked[end - 1]))
                score.append(best)
                back.append(link)
            ids, end = [], len(marked)
            while end:
                start, i = back[end]
                ids.extend([i] if i >= 0 else [self.byte_ids[b] for b in reversed(self._utf8(marked[start]))])
                end = start
            into[word] = np.array(ids[::-1], "<u4").tobytes()
            before = marked

    @staticmethod
    def _utf8(ch: str) -> bytes:
        return (MARK if ch == "\udcff" else ch).encode("utf-8", "surrogatepass")

    def encode_many(self, texts: list[str | None]) -> list[bytes | None]:
        """Serialized ids (little-endian unsigned 32-bit) of whole texts."""
        split = [_WORD.findall(" " + t) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        long = {w for w in new if len(w) > CACHED_LENGTH}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
            new = set(chain.from_iterable(split))
        known = self.known
        self.learn(new - long, known)
        if long:
            here: dict[str, bytes] = {}
            self.learn(long, here)
            return [None if t is None else b"".join(here[w] if w in here else known[w] for w in words) for t, words in zip(texts, split, strict=True)]
        return [None if t is None else b"".join(map(known.__getitem__, words)) for t, words in zip(texts, split, strict=True)]

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def shared(path: str) -> Pieces:
    """One vocabulary for each Python worker, so that its cache outlives a task."""
    return Pieces(path)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and `ids` (array of ids) of every text; null for null."""
    path = vocabulary or default_vocabulary()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = shared(path).encode_many(batch.column("text").to_pylist())
            ids = pa.array([None if r is None else np.frombuffer(r, "<u4").astype(np.int32) for r in raw], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), code, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the text that `ids` stand for."""
    path = vocabulary or default_vocabulary()

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            out = [shared(path).decode(None if x is None else np.array(x, "<u4").tobytes()) for x in (i.values.to_numpy() if i.is_valid else None for i in ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_batches(coded.select("doc_id", "ids"), text, "doc_id long, text string")


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, `ids` of the whole text, n_ids, and `same`: whether decoding the ids gives the text back. Null for null."""
    path = vocabulary or default_vocabulary()
    schema = "doc_id long, source string, n_ids long, ids array<int>, same boolean"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vocab, texts = shared(path), batch.column("text").to_pylist()
            raw = vocab.encode_many(texts)
            cols = [pa.array([None if r is None else len(r) // 4 for r in raw], pa.int64()), pa.array([None if r is None else np.frombuffer(r, "<u4").astype(np.int32) for r in raw], pa.list_(pa.int32())), pa.array([vocab.decode(r) == t for r, t in zip(raw, texts, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *cols], [x.split()[0] for x in schema.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"), code, schema)


_SCHEMA = "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, same boolean"


def op7(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Each text's ids as their number and crc32, the crc32 of the text decoded from them, and whether it equals the source. A null text counts as empty."""
    path = vocabulary or default_vocabulary()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vocab = shared(path)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            raw = vocab.encode_many(texts)
            back = [vocab.decode(r) for r in raw]
            cols = [[len(r) // 4 for r in raw], [zlib.crc32(r) for r in raw], [zlib.crc32(b.encode("utf-8", "surrogatepass")) for b in back], [b == t for b, t in zip(back, texts, strict=True)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 3, pa.bool_()], strict=True))], [x.split()[0] for x in _SCHEMA.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), digest, _SCHEMA)
