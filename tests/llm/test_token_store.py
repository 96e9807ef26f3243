import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import token_store as ts
from tests.llm import cases

PLAIN = Tokenizer.from_file(ts.default_vocabulary())
ENCODER = ts.Encoder(ts.default_vocabulary())


def crc_of(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="aB1'.sTlv,9ñ×÷ßżЖҀ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​é日\U0001f600<|endoftext|>", max_size=40))
def test_units_encode_as_whole_texts(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


UNMODIFIED = Tokenizer.from_file(ts.default_vocabulary())
PIECES = st.sampled_from(["<|endoftext|>", "<|endoftext|", "|>", " ", "\n", "a", "B1", ".", ", ", "é日", "word "])


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_added_tokens_encode_as_by_an_unmodified_tokenizer(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == UNMODIFIED.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_documents(spark):
    texts = ["one <|endoftext|> two", "plain", "<|endoftext|>", "x<|endoftext|><|endoftext|>. y"]
    out = sorted(map(tuple, ts.op9(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    start = 0
    for row, text in zip(out, texts, strict=True):
        ids = [*UNMODIFIED.encode(text, add_special_tokens=False).ids, ts.END_ID]
        assert row[1:] == (start, len(ids), crc_of(ids)) and (50256 in ids) == ("<|" in text)
        start += len(ids)


def expected(rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, ts.END_ID]
        out.append((doc_id, start, len(ids), crc_of(ids)))
        start += len(ids)
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, ts.op9(docs).collect()))) == sorted(map(str, expected(rows)))


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_odd_and_empty(spark):
    check(cases.odd(spark))
    assert ts.op9(cases.empty(spark)).count() == 0


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(ts, "_CACHE_UNITS", 5)
    small = ts.Encoder(ts.default_vocabulary())
    for text in ("one two three four", "four five six seven eight nine", "a considerably longer word and one"):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids
        assert len(small.known) <= max(5, len(text.split()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.sampled_from(["a's b", "it'll", "1a'2", "<|endoftext|> x", "", " ", "x  "])), max_size=8))
def test_columns_encode_as_single_texts(texts):
    import pyarrow as pa

    found = ENCODER.encode_column(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_rows_of_one_doc_id_keep_a_fixed_order(spark):
    rows = [(5, f"text {i} of many words") for i in range(40)] + [(4, "a"), (6, None)]
    first, again = (ts.op9(spark.createDataFrame(x, "doc_id long, text string").repartition(3)).collect() for x in (rows, rows[::-1]))
    assert sorted(first) == sorted(again)
    ids = [len(PLAIN.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    assert sorted(r.start + r.n_tokens for r in first)[-1] == sum(ids)


def test_lookup(spark):
    store = ts.write(cases.odd(spark))
    assert ts.lookup(store, 7) == [[*PLAIN.encode("two words").ids, 2]]
    assert len(ts.lookup(store, 2)) == 2 and ts.lookup(store, 99) == []
