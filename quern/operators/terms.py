"""Terms of texts as numbers: Arrow divides texts at white space, and each distinct chunk of some texts is cut into terms once.

Words repeat so often that cutting them one by one is most of the work of a pass over texts; `text.tokens` says what the terms are.
"""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx

#: Bytes of texts that are cut at once.
SLICE = 16 << 20
#: What may stand around a word without changing its term; apostrophes and `&` do.
MARKS = string.punctuation.translate({ord(c): None for c in "'&"})


def _cut(chunks: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """The terms of chunks and their stems, and for each chunk where its terms start and how many they are."""
    odd = pc.not_equal(pc.binary_length(chunks), pc.utf8_length(chunks))
    folded = tx.folded("\n".join(chunks.filter(odd).to_pylist())).split("\n")
    bare = pc.ascii_lower(pc.ascii_trim(pc.replace_with_mask(chunks, odd, pa.array(folded)) if pc.any(odd).as_py() else chunks, characters=MARKS))
    plain = pc.ascii_is_alnum(bare)
    words = bare.filter(plain)
    plural = pc.and_(pc.ends_with(words, "s"), pc.greater(pc.binary_length(words), 3))
    stems = pc.replace_with_mask(words, plural, pa.array([tx.stem_of(w) for w in words.filter(plural).to_pylist()], pa.string()))
    others = [tx.terms_of_chunk(c) for c in chunks.filter(pc.invert(plain)).to_pylist()]
    is_plain, sizes = plain.to_numpy(zero_copy_only=False), np.ones(len(chunks), np.int32)
    sizes[~is_plain] = np.fromiter(map(len, others), np.int32, len(others))
    starts = np.empty(len(chunks), np.int32)
    starts[is_plain] = np.arange(len(words))
    starts[~is_plain] = len(words) + np.cumsum(sizes[~is_plain]) - sizes[~is_plain]
    flat = [x for found in others for x in found]
    return pa.concat_arrays([words, pa.array([t for t, _ in flat], pa.string())]), pa.concat_arrays([stems, pa.array([s for _, s in flat], pa.string())]), starts, sizes


def read(texts: pa.Array, keep_stopwords: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of texts, and the text and the number of the term at each place, in order: what `tokens` gives."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    held, chunks = pc.list_value_length(split).to_numpy(), split.flatten().dictionary_encode()
    del split
    terms, stems, starts, sizes = _cut(chunks.dictionary)
    stems = stems.dictionary_encode()
    number = stems.indices.to_numpy()
    if not keep_stopwords:
        stop = pa.array(tx.STOPWORDS)
        short = pc.and_(pc.less(pc.binary_length(stems.dictionary), 2), pc.invert(pc.is_in(stems.dictionary, pa.array(list(string.digits)))))
        gone = pc.or_(short, pc.is_in(stems.dictionary, stop)).to_numpy(zero_copy_only=False)[number] | pc.is_in(terms, stop).to_numpy(zero_copy_only=False)
        number = np.where(gone, np.int32(-1), number)
    which, doc = chunks.indices.to_numpy(), np.repeat(np.arange(len(texts), dtype=np.int32), held)
    each = sizes[which]
    at = np.repeat(starts[which] - np.cumsum(each, dtype=np.int32) + each, each) + np.arange(each.sum(), dtype=np.int32)
    doc, number = np.repeat(doc, each), number[at]
    return (stems.dictionary, doc, number) if keep_stopwords else (stems.dictionary, doc[number >= 0], number[number >= 0])


def freeing(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`fn`, after whose end a worker gives back to the system what it has freed; workers wait for later tasks beside the JVM."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return freed


def slices(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE bytes of the column `by`; a longer text is a part of its own."""
    for batch in batches:
        if len(batch):
            until = np.cumsum(pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.r_[0, np.flatnonzero(np.diff(until // SLICE)) + 1, len(batch)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield batch.slice(a, b - a)


def distinct(doc: np.ndarray, number: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct terms, as texts and numbers in order, and how often each occurs."""
    key = doc * np.int64(terms) + number
    key.sort()
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    doc, number = np.divmod(key[starts], max(1, terms))
    return doc, number, np.diff(np.r_[starts, len(key)])


def _counts(batches: Iterator[pa.RecordBatch], keep_stopwords: bool) -> Iterator[pa.RecordBatch]:
    """term and df: in how many of some texts a term is; other texts give further rows of it."""
    for part in slices(batches, "text"):
        terms, doc, number = read(part.column("text"), keep_stopwords)
        df = np.bincount(distinct(doc, number, len(terms))[1], minlength=len(terms))
        yield pa.RecordBatch.from_arrays([terms, pa.array(df)], ["term", "df"]).filter(pa.array(df > 0))


def frequencies(texts: DataFrame, keep_stopwords: bool = False) -> DataFrame:
    """term and df: in how many rows of texts (text) a term is. What is shuffled is a row for each task and term, not for each text and term."""
    counted = texts.select("text").mapInArrow(freeing(lambda b: _counts(b, keep_stopwords)), "term string, df long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))
