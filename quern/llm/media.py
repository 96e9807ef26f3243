"""Media columns: motion-JPEG in AVI, with every payload byte kept in a DCT coefficient.

A payload is cut into frames of 576 bytes. A frame is a 32 x 32 grey baseline JPEG of 16 blocks; each block holds 36 bytes as
its first AC coefficients. JPEG codes a coefficient of size class 8 as a Huffman code and eight bits that tell its 256
possible values apart, so those eight bits are the byte: the format's unit is the coefficient, and storing it is lossless,
whatever pixels it makes. Frames come back through the RIFF index; shots are cuts where the difference of two frames' pixel
histograms stands out from those before it, and clips are the timed runs between cuts.

Defined results: a null or empty text is one frame of padding. Equal texts give equal media, clips and digests. Repeated rows
are handled one by one. Texts of any length are coded some thousand frames at a time. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_batches, texts_of

SIDE = 32
BLOCKS = 16
COEFFICIENTS = 36
FRAME_BYTES = BLOCKS * COEFFICIENTS
FPS = 25
BINS = 16
WINDOW = 8
_BLOCK_BITS = 1 + 9 * COEFFICIENTS + 2
_ENTROPY_BYTES = BLOCKS * _BLOCK_BITS // 8
_CHUNK = 2048

# The zigzag order of a block's coefficients, by the rule that diagonals alternate in direction.
ZIGZAG = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, list[int]]) -> bytes:
    """A Huffman table: code length -> symbols."""
    return bytes([kind, *(len(lengths.get(n, [])) for n in range(1, 17)), *(s for n in sorted(lengths) for s in lengths[n])])


_HEAD = (
    b"\xff\xd8"
    + _marker(0xDB, bytes([0, *[1] * 64]))
    + _marker(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _marker(0xC4, _table(0x00, {1: [0]}))
    + _marker(0xC4, _table(0x10, {1: [0x08], 2: [0x00]}))
    + _marker(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def frames_of(payload: bytes) -> list[bytes]:
    """JPEG frames that hold the payload, whose length is a multiple of FRAME_BYTES."""
    data, out = np.frombuffer(payload, np.uint8).reshape(-1, COEFFICIENTS), []
    for at in range(0, len(data), _CHUNK * BLOCKS):
        part = data[at : at + _CHUNK * BLOCKS]
        bits = np.zeros((len(part), _BLOCK_BITS), np.uint8)  # a zero bit codes "no DC change" and "size class 8, no run"
        bits[:, 1:-2].reshape(len(part), COEFFICIENTS, 9)[:, :, 1:] = np.unpackbits(part, axis=1).reshape(len(part), COEFFICIENTS, 8)
        bits[:, -2] = 1  # end of block
        packed = np.packbits(bits.reshape(-1, BLOCKS * _BLOCK_BITS), axis=1)
        out += [_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed]
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes]) -> bytes:
    """An AVI file of one motion-JPEG stream with an index."""
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def parse(media: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the frames of an AVI file, found through its index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, per_frame = 12, None, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            per_frame = struct.unpack_from("<I", media, at + 20)[0]
        elif name == b"idx1":
            index = np.frombuffer(media, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("the file has no frames or no index")
    return 1e6 / per_frame, [media[movi + a + 8 : movi + a + 8 + n] for i, a, n in zip(index["id"].tolist(), index["at"].tolist(), index["size"].tolist(), strict=True) if i == b"00dc"]


def _codes(frame: bytes) -> tuple[dict, int]:
    """The Huffman codes of a frame by (class, length, code), and where its entropy-coded bytes start."""
    found, at = {}, 2
    while True:
        kind, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if kind == 0xC4:
            while body:
                counts, code, k = body[1:17], 0, 17
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        found[body[0] >> 4, n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                body = body[k:]
        at += 2 + size
        if kind == 0xDA:
            return found, at


def decode_any(frame: bytes, blocks: int = BLOCKS) -> np.ndarray:
    """Coefficients (blocks, 64) in zigzag order of any grey baseline frame, bit by bit."""
    codes, at = _codes(frame)
    bits = np.unpackbits(np.frombuffer(frame[at:-2].replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
    out, dc, pos = np.zeros((blocks, 64), np.int32), 0, 0

    def symbol(kind: int) -> int:
        nonlocal pos
        code = 0
        for n in range(1, 17):
            code, pos = 2 * code + bits[pos], pos + 1
            if (kind, n, code) in codes:
                return codes[kind, n, code]
        raise ValueError("no such Huffman code")

    def value(size: int) -> int:
        nonlocal pos
        v = int("".join(map(str, bits[pos : pos + size])) or "0", 2)
        pos += size
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    for block in out:
        dc += value(symbol(0))
        block[0], k = dc, 1
        while k < 64:
            s = symbol(1)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                block[k] = value(s & 15)
            k += 1
    return out


def coefficients(frames: list[bytes]) -> np.ndarray:
    """AC coefficients (frames, BLOCKS, COEFFICIENTS). Frames of the fixed layout are decoded together, others bit by bit."""
    bodies = [f[len(_HEAD) : -2].replace(b"\xff\x00", b"\xff") if f.startswith(_HEAD) else b"" for f in frames]
    out = np.zeros((len(frames), BLOCKS, COEFFICIENTS), np.int16)
    usual = np.array([len(b) == _ENTROPY_BYTES for b in bodies])
    if usual.any():
        bits = np.unpackbits(np.frombuffer(b"".join(b for b, u in zip(bodies, usual, strict=True) if u), np.uint8)).reshape(-1, BLOCKS, _BLOCK_BITS)
        each = bits[:, :, 1:-2].reshape(-1, BLOCKS, COEFFICIENTS, 9)
        fixed = ~(bits[:, :, 0].any(1) | each[..., 0].any((1, 2)) | (bits[:, :, -2] != 1).any(1) | bits[:, :, -1].any(1))
        byte = np.packbits(each[..., 1:], axis=-1)[..., 0].astype(np.int16)
        out[usual] = np.where(byte < 128, byte - 255, byte)
        usual[np.flatnonzero(usual)[~fixed]] = False
    for i in np.flatnonzero(~usual):
        out[i] = decode_any(frames[i])[:, 1 : COEFFICIENTS + 1]
    return out


def payload_of(coefs: np.ndarray) -> bytes:
    """The bytes that coefficients of size class 8 hold."""
    return np.where(coefs < 0, coefs + 255, coefs).astype(np.uint8).tobytes()


def _inverse_dct() -> np.ndarray:
    """Coefficients to pixels, in 256ths: integers, so that sums are exact in any order."""
    x = np.arange(8)
    basis = np.sqrt(np.where(x == 0, 1, 2) / 8)[:, None] * np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16)
    return np.rint(256 * np.stack([np.outer(basis[v], basis[u]).ravel() for v, u in ZIGZAG[1 : COEFFICIENTS + 1]])).astype(np.float32)


_IDCT = _inverse_dct()


def histograms(coefs: np.ndarray) -> np.ndarray:
    """Counts of grey levels in BINS bins for each frame."""
    acc = (coefs.reshape(-1, COEFFICIENTS).astype(np.float32) @ _IDCT).astype(np.int32)
    level = np.clip((acc + 128 * 256 + 128) >> 8, 0, 255) // (256 // BINS)
    frame = np.repeat(np.arange(len(coefs)) * BINS, SIDE * SIDE)
    return np.bincount(frame + level.reshape(len(coefs), -1).ravel(), minlength=len(coefs) * BINS).reshape(-1, BINS)


def cuts(hists: np.ndarray) -> list[int]:
    """Frames at which a shot starts: the first, and those whose difference from the frame before stands out.

    A difference stands out if it exceeds the mean of the WINDOW differences before it by three of their standard deviations,
    and an eighth of the pixels moved.
    """
    diff = np.abs(np.diff(hists, axis=0)).sum(axis=1) // 2
    n = np.minimum(np.arange(len(diff)), WINDOW)
    total, square = (np.concatenate([[0], np.cumsum(diff**k)]) for k in (1, 2))
    i = np.arange(len(diff))
    s, q = total[i] - total[i - n], square[i] - square[i - n]
    over = diff * n - s  # n times the excess over the mean
    stands = (over > 0) & (over.astype(np.float64) ** 2 > 9.0 * (n * q - s * s)) & (n >= 2) & (8 * diff > SIDE * SIDE)
    return [0, *(np.flatnonzero(stands) + 1).tolist()]


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // FRAME_BYTES)) * FRAME_BYTES
    return len(raw), raw.ljust(size, b"\xff")


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text, and `media`: its AVI file."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in texts_of(batch):
                n, payload = padded(text)
                sizes.append(n)
                media.append(avi(frames_of(payload)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), code, "doc_id long, n_bytes long, media binary")


def watch(media: bytes) -> tuple[bytes, list[tuple[int, int, float, float]]]:
    """The payload of an AVI file and its clips: first frame, frame after the last, and both in seconds."""
    fps, frames = parse(media)
    payload, hists = [], []
    for at in range(0, len(frames), _CHUNK):
        coefs = coefficients(frames[at : at + _CHUNK])
        payload.append(payload_of(coefs))
        hists.append(histograms(coefs))
    starts = cuts(np.concatenate(hists))
    return b"".join(payload), [(a, b, a / fps, b / fps) for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)]


def clips(media: DataFrame) -> DataFrame:
    """One row per clip of each AVI file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, *c) for d, m in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True) for i, c in enumerate(watch(m.as_py())[1])]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [*[pa.int64()] * 4, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s"])

    return map_batches(media.select("doc_id", "media"), cut, "doc_id long, clip long, first_frame long, end_frame long, start_s double, end_s double")


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op8(docs: DataFrame) -> DataFrame:
    """Digests of the payload as read back from each text's AVI file, and its clips as a string."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for m in batch.column("media"):
                media = m.as_py()
                payload, found = watch(media)
                shots = ",".join(f"{a}-{b}@{s:.2f}" for a, b, s, _ in found)
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"clips={len(found)};{shots}")
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in _SCHEMA.split(", ")])

    return map_batches(encode(docs), digest, _SCHEMA)
