import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import pieces
from tests.llm import cases

VOCAB = pieces.Pieces(pieces.default_vocabulary())


def ids_of(text):
    return np.frombuffer(VOCAB.encode_many([text])[0], "<u4").tolist()


def best_score(marked):
    """The best score of a marked word by plain dynamic programming over all pieces, without any sharing."""
    best = [0.0] + [-1e18] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(end):
            if (hit := VOCAB.pieces.get(marked[start:end])) is not None:
                best[end] = max(best[end], best[start] + hit[0])
        if best[end] == -1e18:
            best[end] = best[end - 1] + pieces.BYTE_SCORE * len(marked[end - 1].encode())
    return best[-1]


def test_scores_are_best(spark):
    words = {w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect() for w in r.text.split()}
    found: dict = {}
    VOCAB.learn({" " + w for w in words}, found)
    of = {i: s for s, i in VOCAB.pieces.values()}
    for w in list(words)[:1500]:
        ids = np.frombuffer(found[" " + w], "<u4").tolist()
        score = sum(of.get(i, pieces.BYTE_SCORE) for i in ids)
        assert abs(score - best_score("▁" + w)) < 1e-9


def test_equals_the_library_under_the_same_scores():
    """The library's unigram encoder, given these pieces and scores, segments words alike."""

    def field(n, kind, body):
        return bytes([n << 3 | kind]) + (len(body).to_bytes(1, "little") if kind == 2 and len(body) < 128 else b"") + body

    order = sorted(VOCAB.pieces.items(), key=lambda kv: kv[1][1])[:20000]
    items = [(b"<unk>", -100.0, 2), (b"<s>", 0.0, 3), (b"</s>", 0.0, 3)] + [(p.encode(), s, 1) for p, (s, _) in order]
    proto = b"".join(field(1, 2, field(1, 2, p) + bytes([2 << 3 | 5]) + np.float32(s).tobytes() + bytes([3 << 3, k])) for p, s, k in items)
    trainer = bytes([3 << 3, 1])  # model_type: unigram
    normal = field(1, 2, b"identity")
    proto += field(2, 2, trainer) + field(3, 2, normal)
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    allowed = {p for p, _ in order}
    mine = pieces.Pieces(pieces.default_vocabulary())
    mine.pieces = {p: v for p, v in mine.pieces.items() if p in allowed}
    for word in "the reading unbelievable erinthenty international misunderstanding xylophone queaux Gesellschaft tokenisation".split():
        got = [mine.strings[i] for i in np.frombuffer(mine.encode_many([word])[0], "<u4").tolist()]
        want = model.encode(word, out_type=str)
        score = lambda ps: sum(mine.pieces[p][0] for p in ps)
        assert abs(score(got) - score(want)) < 1e-4, (got, want)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab the▁ \n\t\r  é日\U0001f600x,.", max_size=50))
def test_round_trip(text):
    assert VOCAB.decode(VOCAB.encode_many([text])[0]) == text


def test_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert all(r.same and r.n_ids > 0 for r in pieces.op7(docs).collect())
    assert dict(pieces.decode(pieces.encode(docs)).collect()) == {r.doc_id: r.text for r in docs.collect()}


def test_odd_and_empty(spark):
    odd = cases.odd(spark)
    assert all(r.same for r in pieces.op7(odd).collect())
    back = pieces.decode(pieces.encode(odd)).collect()
    assert sorted(map(str, back)) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert pieces.op7(cases.empty(spark)).count() == 0
