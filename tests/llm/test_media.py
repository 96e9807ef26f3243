import hashlib
import zlib

import numpy as np

from quern.llm import media
from tests.llm import cases


def brute(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def check(docs):
    want = sorted(str((r.doc_id, *brute(r.text))) for r in docs.select("doc_id", "text").collect())
    out = media.op8(docs).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in out) == want
    return out


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_odd_and_empty(spark):
    out = check(cases.odd(spark))
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in out}) == len({r.payload_sha256 for r in out})
    assert media.op8(cases.empty(spark)).count() == 0


def test_fixed_layout_equals_the_bitwise_decoder():
    payload = bytes(np.random.default_rng(3).integers(0, 256, 576 * 5, dtype=np.uint8)) + b"\xff" * 576 + b"\0" * 576
    frames = media.frames_of(payload)
    coefs = media.coefficients(frames)
    assert media.payload_of(coefs) == payload
    for frame, got in zip(frames, coefs, strict=True):
        whole = media.decode_any(frame)
        assert (whole[:, 1:37] == got).all() and not whole[:, 0].any() and not whole[:, 37:].any()


def test_index_and_times():
    fps, frames = media.parse(media.avi(media.frames_of(b"abc" * 576)))
    assert fps == 25 and len(frames) == 3 and all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in frames)


def test_a_change_of_scene_is_a_cut():
    still, other = np.full((1, 16), 64), np.array([[1024] + [0] * 15])
    assert media.cuts(np.repeat(np.concatenate([still, other]), [10, 7], axis=0)) == [0, 10]
    assert media.cuts(np.repeat(still, 9, axis=0)) == [0]


def test_clips_cover_all_frames(spark):
    docs = spark.createDataFrame([(1, "a" * 6000 + "zq" * 6000)], "doc_id long, text string")
    rows = media.clips(media.encode(docs)).orderBy("clip").collect()
    assert rows[0].first_frame == 0 and rows[-1].end_frame == -(-18000 // 576)
    assert all(a.end_frame == b.first_frame for a, b in zip(rows, rows[1:]))
