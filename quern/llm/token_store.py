"""Token-id output: one zstandard frame per document under a shared dictionary, with an offset index.

The file format is a Parquet table of segments in ascending doc_id order. A segment holds the frames of some hundred
neighbouring documents one after another in `payload`, and beside it their doc_ids, token counts and the end offset of each
frame, so one short document is read by slicing its frame and decompressing only that. Ids are little-endian unsigned
integers of `width` bytes. Each segment names the dictionary by its SHA-256; the dictionary is a one-row table beside it.

The dictionary alone is trained on a bounded sample (DICT_DOCS documents, those of the least hash of doc_id, DICT_IDS ids of
each): it affects size, never content. Every document is encoded and stored whole.

Defined results: a null or empty text stores only the end id. Rows of one doc_id stand in order of a hash of their text; repeated
rows are stored as often as they come. A null doc_id comes first. An empty table gives no segments. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import map_batches, new_path, remove, stored

END_ID = 2
DICT_BYTES = 65_536
DICT_DOCS = 2_000
DICT_IDS = 4_096
SEGMENT_DOCS = 256
SEGMENT_BYTES = 1 << 20
LEVEL = 3
_CACHE_UNITS = 1_000_000
_BATCH_BYTES = 8 << 20


#: Classes of bytes. OTHER is what one byte does not tell: parts of longer characters, and control characters.
_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _LINE, _KINDS = range(8)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _MARK
for _first, _last in (b"AZ", b"az"):
    _KIND[_first : _last + 1] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[ord("'")], _KIND[32], _KIND[9:14] = _QUOTE, _SPACE, _LINE
#: First bytes of two-byte characters that are letters, but for two: U+00C0 to U+017F and U+0400 to U+047F.
_LEADS = np.isin(np.arange(256), (0xC3, 0xC4, 0xC5, 0xD0, 0xD1))
_VISIBLE = np.isin(np.arange(_KINDS), (_LETTER, _DIGIT, _MARK, _QUOTE))


def _always_cut(a: int, b: int) -> bool:
    """Whether the pre-tokenizer cuts between neighbours of these classes, whatever stands around them."""
    if not _VISIBLE[a]:
        return bool(a == _LINE and _VISIBLE[b])
    marks = (_MARK, _QUOTE)
    alike = a == b or (a in marks and b in marks)
    return b != _OTHER and not alike and not (a == _QUOTE and b == _LETTER)  # 's and the like stay whole


_CUT = np.array([_always_cut(a, b) for a in range(_KINDS) for b in range(_KINDS)])
#: Units that the pre-tokenizer leaves whole.
_PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5\xd0\xd1][\x80-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes columns of texts with a byte-level BPE vocabulary; every distinct unit of a batch is looked up once.

    A text is cut where the vocabulary's own pre-tokenizer always cuts, by the classes of two neighbouring bytes. A unit of one
    class (and a space before it) goes to the vocabulary's BPE model, any other to the whole tokenizer. Ids of units are
    remembered in a bounded cache; when it is full, units not met for longest go.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("an added token of the vocabulary takes in or minds its neighbours")
        self.added = "|".join(map(re.escape, sorted((t.content for t in added), key=len, reverse=True)))
        self.letters = str.maketrans(_byte_letters())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, self.dtype)
        self.ends = np.zeros(1 << 12, np.int64)  # unit i has pool[ends[i] : ends[i + 1]]
        self.met = np.zeros(1 << 12, np.int64)  # the batch that last held the unit
        self.turn = 0

    def whole(self, text: str) -> list[int]:
        """What the unmodified tokenizer gives."""
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ids(self, unit: bytes) -> list[int]:
        if _PLAIN.fullmatch(unit):
            return [t.id for t in self.model.tokenize(unit.decode("latin-1").translate(self.letters))]
        return self.whole(unit.decode("utf-8", "surrogatepass"))

    def _rows(self, units: list[bytes]) -> np.ndarray:
        """The cache's row of each of these distinct units, after learning those that are new."""
        self.turn += 1
        if len(self.known) + len(units) > _CACHE_UNITS:
            self._make_room(len(units))
        rows = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(rows < 0)
        if len(new):
            found = [self._ids(units[i]) for i in new.tolist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            first, n = len(self.known), int(self.ends[len(self.known)])
            self.pool = _grown(self.pool, n + int(sizes.sum()))
            self.pool[n : n + int(sizes.sum())] = np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum()))
            self.ends, self.met = _grown(self.ends, first + len(new) + 1), _grown(self.met, first + len(new) + 1)
            self.ends[first + 1 : first + len(new) + 1] = n + np.cumsum(sizes)
            rows[new] = np.arange(first, first + len(new))
            self.known.update(zip((units[i] for i in new.tolist()), range(first, first + len(new)), strict=True))
        self.met[rows] = self.turn
        return rows

    def _make_room(self, more: int) -> None:
        """Keep the units met last, at most half as many as the cache holds, and none if the batch alone would fill it."""
        n, turn = len(self.known), self.turn
        keep = min(n, max(0, min(_CACHE_UNITS // 2, _CACHE_UNITS - more)))
        stay = np.zeros(n, bool)
        stay[np.argsort(-self.met[:n], kind="stable")[:keep]] = True
        old, pool, ends, met = list(self.known), self.pool, self.ends, self.met
        self._forget()
        self.turn, kept = turn, np.flatnonzero(stay)
        sizes = ends[kept + 1] - ends[kept]
        self.pool = _grown(self.pool, int(sizes.sum()))
        self.pool[: int(sizes.sum())] = pool[_runs(ends[kept], sizes)]
        self.ends, self.met = _grown(self.ends, keep + 1), _grown(self.met, keep + 1)
        self.ends[1 : keep + 1], self.met[:keep] = np.cumsum(sizes), met[kept]
        self.known = {old[i]: k for k, i in enumerate(kept.tolist())}

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """The ids of whole texts (null: none), serialized."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        odd = np.flatnonzero(special).tolist()
        apart = {i: np.array(self.whole(texts[i].as_py()), self.dtype).tobytes() for i in odd}
        if odd:
            texts = pc.if_else(pa.array(special), "", texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return [apart.get(i, b"") for i in range(len(texts))]
        starts = _cuts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        rows = self._rows(units.dictionary.to_pylist())[units.indices.to_numpy()]
        sizes = self.ends[rows + 1] - self.ends[rows]
        flat = self.pool[_runs(self.ends[rows], sizes)]
        at = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)].tolist()
        return [apart[i] if i in apart else flat[at[i] : at[i + 1]].tobytes() for i in range(len(texts))]

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0]


def _byte_letters() -> dict[str, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): chr(b) for b in visible} | {chr(b): chr(256 + i) for i, b in enumerate(hidden)}


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    out = np.zeros(max(size, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of runs one after another."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the units of texts that stand one after another, `offsets` being where texts begin and end."""
    kind = _KIND[data]
    lead = np.flatnonzero(_LEADS[data])  # whole characters follow: the texts are UTF-8
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]  # not the signs of multiplying and dividing
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.empty(len(data), bool)
    cut[1:] = _CUT[kind[:-1] * np.uint8(_KINDS) + kind[1:]]
    joins = (kind == _SPACE) | (kind == _LINE)  # the last of a run of white space stands apart from it: a space joins what follows
    joins[:-1] &= _VISIBLE[kind[1:]]
    joins[offsets[1:][offsets[1:] > 0] - 1] = False
    cut[1:] |= joins[1:]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def shared_encoder(path: str, dtype: str) -> Encoder:
    """One encoder for each Python worker, so that its cache outlives a task."""
    return Encoder(path, dtype)


def serializer(path: str, end_id: int):
    """text -> serialized ids with the end id, and the bytes of one id."""
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    return f"<u{width}", width


@dataclass(frozen=True)
class Store:
    """A written token store."""

    spark: SparkSession
    path: str

    def segments(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments")

    def dictionary(self) -> tuple[str, bytes]:
        row = self.spark.read.parquet(f"{self.path}/dictionary").first()
        return row.dict_sha256, bytes(row.content)


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary of serialized id arrays of the sample; empty if there are too few to train one.

    The sample's doc_ids are chosen first, without texts, so no task sorts texts and at most DICT_DOCS of them move.
    """
    dtype, _ = serializer(vocabulary, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(vocabulary, dtype), np.array([end_id], dtype).tobytes()
        for batch in batches:
            ids = [(raw + end)[: DICT_IDS * len(end)] for raw in encoder.encode_column(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICT_DOCS).distinct()
    texts = docs.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    samples = sorted(bytes(r.ids) for r in map_batches(texts, encode, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID) -> Store:
    """Encode, compress and store all documents. Texts are encoded where they lie; only their frames move, once, into doc_id order."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    path = path or new_path(spark, "tokens")
    dtype, width = serializer(vocabulary, end_id)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    content = train_dictionary(docs, vocabulary, end_id)
    sha = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(sha, bytearray(content))], "dict_sha256 string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")
    loaded = spark.sparkContext.broadcast(content)  # at most DICT_BYTES

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(vocabulary, dtype), np.array([end_id], dtype).tobytes()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(loaded.value) if loaded.value else None)
        for batch in batches:
            raw = [body + end for body in encoder.encode_column(batch.column("text"))]
            counts, frames = pa.array([len(r) // width for r in raw], pa.int64()), pa.array([packer.compress(r) for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), counts, frames], ["doc_id", "tie", "n", "frame"])

    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    frames_at = new_path(spark, "token-frames")
    framed = map_batches(keyed, compress, "doc_id long, tie long, n long, frame binary", rows=1 << 16, size=_BATCH_BYTES)
    framed = stored(framed, frames_at, compression="uncompressed")
    schema = "seq long, first_start long, width int, dict_sha256 string, doc_ids array<long>, n_tokens array<long>, frame_ends array<long>, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, start, ids, counts, ends, frames, size = 0, 0, [], [], [], [], 0

        def segment() -> pa.RecordBatch:
            values = ([seq], [start], [width], [sha], [ids], [counts], [ends], [b"".join(frames)])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "frame")), strict=True):
                frames.append(frame)
                size += len(frame)
                ids.append(doc_id)
                counts.append(n)
                ends.append(size)
                if len(ids) >= SEGMENT_DOCS or size >= SEGMENT_BYTES:
                    yield segment()
                    seq, start = seq + 1, start + sum(counts)
                    ids, counts, ends, frames, size = [], [], [], [], 0
        if ids:
            yield segment()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("frame")]
    ranged = framed.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "n", "frame")
    packed = map_batches(ranged, pack, schema)
    packed.withColumn("part", F.spark_partition_id()).write.option("compression", "uncompressed").parquet(f"{path}/segments")
    remove(spark, frames_at)
    return Store(spark, path)


def read(store: Store) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, from the stored files.

    Segments count tokens from the start of their part; the parts' own starts are a prefix sum over one row for each part,
    which is all that is broadcast: as many rows as `write` had partitions.
    """
    sha, content = store.dictionary()
    segments = store.segments()
    totals = segments.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("part_start"))
    placed = segments.join(F.broadcast(starts), "part")
    placed = placed.select((F.col("part_start") + F.col("first_start")).alias("start"), "width", "dict_sha256", "doc_ids", "n_tokens", "frame_ends", "payload")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != sha:
                    raise ValueError(f"the segment needs dictionary {row['dict_sha256']}, the store has {sha}")
                start, last, out = row["start"], 0, [[], [], []]
                for n, end in zip(row["n_tokens"], row["frame_ends"], strict=True):
                    raw = unpacker.decompress(row["payload"][last:end])
                    if len(raw) != n * row["width"]:
                        raise ValueError("a frame's length differs from its index")
                    for c, v in zip(out, (start, n, np.frombuffer(raw, f"<u{row['width']}").astype("<u4").tobytes()), strict=True):
                        c.append(v)
                    start, last = start + n, end
                arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])

    return map_batches(placed, unpack, "doc_id long, start long, n_tokens long, ids binary", rows=8)


def lookup(store: Store, doc_id: int) -> list[list[int]]:
    """The ids of one doc_id, by its segment's index: only its own frames are decompressed."""
    _, content = store.dictionary()
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    found = store.segments().where(F.array_contains("doc_ids", doc_id)).select("width", "doc_ids", "frame_ends", "payload", "part", "seq").orderBy("part", "seq")
    out = []
    for row in found.toLocalIterator():
        for i, d in enumerate(row.doc_ids):
            if d == doc_id:
                frame = bytes(row.payload[row.frame_ends[i - 1] if i else 0 : row.frame_ends[i]])
                out.append(np.frombuffer(unpacker.decompress(frame), f"<u{row.width}").tolist())
    return out


def op9(docs: DataFrame) -> DataFrame:
    return read(write(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
