"""Filter documents, corpus checks, merges and passes of search against plain definitions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import blocks, corpus, dense, documents, lexical
from quern.plans import search
from quern.sources.tables import table

SF = "/root/testdata/sf0.001"
DOCS = [
    {"a": 1, "s": "x", "t": ["x", "y"], "n": None, "b": True, "o": {"k": 2.5}}, {"a": "1", "s": "xyz", "t": "x"}, {"a": 2.0, "b": False, "o": {"k": "2.5"}}, {}, {"a": [1, 2], "s": "", "n": 0}, {"o": None, "s": None},
]


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({}, [0, 1, 2, 3, 4, 5]), ({"a": 1}, [0, 4]), ({"a": "1"}, [1]), ({"a": {"$ne": 1}}, [1, 2, 3, 5]), ({"n": None}, [0, 1, 2, 3, 5]), ({"n": {"$exists": True}}, [0, 4]), ({"n": {"$exists": False}}, [1, 2, 3, 5]),
        ({"t": "x"}, [0, 1]), ({"s": {"$in": ["x", None]}}, [0, 2, 3, 5]), ({"s": {"$nin": ["x", None]}}, [1, 4]), ({"a": {"$type": "number"}}, [0, 2]), ({"a": {"$type": "array"}}, [4]), ({"n": {"$type": "null"}}, [0]),
        ({"s": {"$regex": "^x"}}, [0, 1]), ({"b": True}, [0]), ({"b": {"$ne": True}}, [1, 2, 3, 4, 5]), ({"o.k": 2.5}, [0]), ({"o.k": {"$gt": 2, "$lte": 2.5}}, [0]), ({"$or": [{"a": 2}, {"$and": [{"s": "x"}, {"b": True}]}]}, [0, 2, 4]), ({"a": {"$eq": 2}}, [2, 4]),
    ],
)
def test_filters(spark, spec, want):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(9, None)], "i long, j string").select("i", F.parse_json("j").alias("d"))
    assert sorted(r.i for r in rows.where(F.col("d").isNotNull() & documents.matches(F.col("d"), spec)).collect()) == want


def test_unknown_operators_are_errors(spark):
    for spec in ({"a": {"$near": 1}}, {"$nor": []}):
        with pytest.raises(ValueError, match="unknown operator"):
            documents.matches(F.col("d"), spec)


def test_corpus_checks_find_what_is_wrong(spark, tmp_path):
    good = ("partner:a", "partner", "A", "A — partner at Show.\nmakes good things", "a", "makes good things", "makes good things", 2026, None, None, None, None, None, None, False)
    bad = [
        good, ("partner:b", "partner", "B", "B — partner, booth no. 4 here", "b", None, None, 2026, None, None, None, None, None, None, False), ("partner:a", "partner", "", "A", "a", "other", "other", 2025, None, None, None, None, None, None, True),
        ("session:s", "session", "S", "S — Show is a session. Access: open", "s", None, None, 2026, True, True, "public", None, None, "Hall 1", False), ("speaker:k", "speaker", "K", "K — x. Speaker in Hall 9 today", "k", None, None, 2026, None, None, None, ["s"], False, None, False),
    ]
    schema = "id string, type string, title string, text string, key string, body string, raw string, year int, closed boolean, attendable boolean, access string, closed_codes array<string>, flagged boolean, hall string, again boolean"
    _, fine = corpus.observed(spark.createDataFrame([good], schema), f"file://{tmp_path}/a", {"partner": 1, "speaker": 0, "session": 0, "closed": 0}, 2026)
    assert all(ok for ok, _ in fine.values()) and len(fine) == 23
    _, said = corpus.observed(spark.createDataFrame(bad, schema), f"file://{tmp_path}/b", {"partner": 2, "speaker": 1, "session": 1, "closed": 1}, 2026)
    assert {k for k, (ok, _) in said.items() if not ok} == {
        "rows", "partner", "ids-unique", "text-and-title", "body-verbatim", "body-last", "five-words", "no-stand-on-partners", "no-hall-elsewhere", "year", "closed-not-attendable", "closed-stated", "closed-by-invitation", "speakers-flagged", "speakers-told"
    }


def test_exports_have_their_columns():
    assert len(blocks.EXHIBITORS) == 42 and list(blocks.EXHIBITORS)[:3] == ["name", "aliases", "slug"] and list(blocks.EXHIBITORS)[-1] == "recordId"


def test_search_in_passes_is_the_same(spark, monkeypatch):
    t = lambda name: table(spark, SF, name)
    once = sorted(map(tuple, search.bm25f_topk(t).collect()))
    monkeypatch.setattr(lexical, "PASS", 2000)
    monkeypatch.setattr(lexical, "BLOCK", 7)
    assert sorted(map(tuple, search.bm25f_topk(t).collect())) == once and once


def test_unknown_rows_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], "id long, v array<double>, kind int")
    assert dense.more_like(rows, spark.createDataFrame([(1,)], "qid long"), 2, -1.0).first().id == 2
    with pytest.raises(Exception, match="no vector of 7"):
        dense.more_like(rows, spark.createDataFrame([(7,)], "qid long"), 2, -1.0).collect()


def test_spans_of_many_terms(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma alpha beta gamma"), (2, "alpha beta"), (3, "gamma")], "id long, text string")
    idx = lexical.index(docs, {"text": 1.0})
    asked = spark.createDataFrame([(5, w, w) for w in ("alpha", "beta", "gamma")], "qid long, wanted string, term string")
    got = {r.id: (r.kinds, r.span) for r in lexical.spans(docs.selectExpr("5L as qid", "id"), asked, idx).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (1, 0)}


def test_postings_by_document(spark):
    """Terms are not shuffled, sorted or hashed by Spark; documents that straddle batches, share an id or have none are put together whole."""
    texts = [(1, "bolt cold bolt", "x1"), (2, "nut " * 30 + "cold", None), (None, "cold nut", "x1"), (3, None, None), (1, "nut bolt", "y2")]
    docs = spark.createDataFrame(texts, "id long, text string, source string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = lexical.postings(docs, {"text": 1.0, "source": 1.0})
        got = {(r.id, r.term): r for r in made.collect()}
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in plan and "Aggregate" not in plan
    assert len(got) == 10 and got[2, "nut"].positions == list(range(30)) and (got[2, "nut"].tf_text, got[2, "nut"].n_text, got[2, "nut"].n_source) == (30, 31, 0)
    assert got[1, "x1"].n_text == 5 and sorted(got[1, "x1"].positions + got[1, "y2"].positions) == [1005, 1006] and (got[1, "bolt"].tf_text, got[1, "x1"].n_source) == (3, 2)
    assert got[None, "cold"].positions == [0] and got[None, "x1"].positions == [1002]
    assert sorted((r.id or 0) for r in got.values() if r.first) == [0, 1, 2]


def test_grid_in_blocks():
    """A block of queries meets a run of rows at once, so a task's memory does not grow with the queries; parts of the rows give the same best."""
    rng = np.random.default_rng(5)
    v, ids = rng.normal(size=(40, 8)), np.arange(40)
    best = lambda parts: {(r["dim"], r["dtype"], r["qid"]): r["id"] for r in sorted((r for b in parts for r in b.to_pylist()), key=lambda r: (r["score"], -r["id"]))}
    cuts = [(4, 0.01), (8, 0.01)]
    whole = best(dense._grid(ids[:6], v[:6], ids, v, cuts, 1))
    assert whole == best(b for q in (0, 3) for r in (0, 15, 30) for b in dense._grid(ids[q : q + 3], v[q : q + 3], ids[r : r + 15], v[r : r + 15], cuts, 1))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = unit[:6] @ unit.T
    scores[np.arange(6), np.arange(6)] = -1
    assert [whole[8, "float", q] for q in range(6)] == scores.argmax(1).tolist() and len(whole) == 24
    assert dense.BLOCK * dense.GRID_ROWS * 8 <= 16 << 20
