"""Fused retrieval and detectors against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import storage
from quern.functions import analysis
from quern.functions import text as tx
from quern.operators import agenda, dense, grading, names, retrieval
from quern.plans import search
from quern.sources.tables import table

SF = "/root/testdata/sf0.001"
FIELDS = search._FIELDS


def plain_retrieval(terms_of, asked, kinds, hints, vectors, boosts, k):
    """The definition, one question and one record after another. terms_of: id -> field -> terms; asked: qid -> term -> weight."""
    n = len(terms_of)
    counts = {d: {f: Counter(ts) for f, ts in fs.items()} for d, fs in terms_of.items()}
    df = Counter(t for fs in counts.values() for t in set().union(*fs.values()))
    mean = {f: np.mean([len(fs[f]) for fs in terms_of.values() if fs[f]]) for f in FIELDS}
    idf = lambda t: max(0.0, math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)))
    out = {}
    for qid, terms in asked.items():
        total = sum(idf(t) * w for t, w in terms.items())
        lexed = {}
        for d, fs in counts.items():
            bm25, credit, marks = 0.0, {}, []
            for wanted, w in terms.items():
                reach = {t for f in FIELDS for t in fs[f] if t == wanted or (len(wanted) >= 5 and t.startswith(wanted))}
                for t in reach:
                    worth = idf(wanted) * w * (1 if t == wanted else 0.45)
                    tfn = sum(FIELDS[f] * fs[f][t] / (0.25 + 0.75 * len(terms_of[d][f]) / mean[f]) for f in FIELDS)
                    bm25 += worth * tfn / (1.2 + tfn)
                    credit[wanted] = max(credit.get(wanted, 0), worth)
                at = 0
                for f in FIELDS:
                    marks += [(at + i, wanted) for i, t in enumerate(terms_of[d][f]) if t in reach]
                    at += len(terms_of[d][f]) + 1000
            if not credit:
                continue
            near, last, best = sorted(marks), {}, math.inf
            for pos, t in near:
                last[t] = pos
                if len(last) == len(credit):
                    best = min(best, pos - min(last.values()))
            close = len(credit) / len(terms) * 10 / (10 + best) if len(terms) > 1 and len(credit) > 1 else 0.0
            lexed[d] = (bm25, min(1.0, sum(credit.values()) / total) if total else 0.0, close)
        cos = {d: float(np.dot(vectors[qid], v)) for d, v in vectors.items() if d in kinds} if qid in vectors else {}
        top25, peak = max((x[0] for x in lexed.values()), default=0), max([0, *cos.values()])
        scores = {}
        for d in terms_of:
            b, c, p = lexed.get(d, (0, 0, 0))
            lex = b / top25 * 0.55 + 0.3 * c + 0.15 * p if top25 and d in lexed else 0
            own = float(np.dot(vectors[qid], vectors[d])) if qid in vectors and d in vectors else 0
            s = 0.55 * lex + 0.3 * (max(0, own) / peak if peak else 0) + 1.6 * min(1, boosts.get((qid, d), 0) / 2) + (0.08 if kinds[d] in hints[qid] else 0)
            if s > 0:
                scores[d] = round(s, 6)
        out[qid] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def inputs(spark, n_docs, n_asked):
    asked, docs, vectors, asked_vectors, lexicon = search.fused(lambda name: table(spark, SF, name))
    docs, asked = docs.where(F.col("id") < n_docs).cache(), asked.where(F.col("qid") < n_asked).cache()
    return asked, docs, vectors.join(docs.select("id"), "id", "left_semi"), asked_vectors, lexicon


@pytest.mark.parametrize("with_vectors", [True, False])
def test_retrieval_by_brute_force(spark, with_vectors):
    asked, docs, vectors, asked_vectors, lexicon = inputs(spark, 80, 12)
    found = retrieval.retrieve(asked, docs, FIELDS, *((vectors, asked_vectors) if with_vectors else (None, None)), lexicon, k=8)
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        got[r.qid].append((r.id, r.score))
    rows = docs.select("id", "kind", *[F.coalesce(tx.tokens(f), F.array().cast("array<string>")).alias(f) for f in FIELDS]).collect()
    terms_of, kinds = {r.id: {f: r[f] for f in FIELDS} for r in rows}, {r.id: r.kind for r in rows}
    read = asked.select("qid", analysis.analyse("text").alias("a")).collect()
    boosts = {(r.qid, r.id): r.boost for r in names.total(names.scan(asked, lexicon)).collect()}
    by_id = {r.id: np.array(r.v, float) for r in vectors.collect()} if with_vectors else {}
    want = plain_retrieval(terms_of, {r.qid: {t.term: t.weight for t in r.a.terms} for r in read}, kinds, {r.qid: r.a.hints for r in read}, by_id, boosts, 8)
    assert got.keys() == want.keys()
    for qid, hits in want.items():
        assert [s for _, s in got[qid]] == pytest.approx([s for _, s in hits], abs=2e-6)
        assert {d for d, s in got[qid] if s > hits[-1][1] + 2e-6} == {d for d, s in hits if s > hits[-1][1] + 2e-6}


def test_pages_skip_what_was_seen(spark):
    found = spark.createDataFrame([(1, i, i) for i in range(1, 8)], "qid int, id int, rank int")
    seen = spark.createDataFrame([(1, 1), (1, 4)], "qid int, id int")
    assert [r.id for r in retrieval.next_page(found, seen, 3).orderBy("place").collect()] == [2, 3, 5]
    records = spark.createDataFrame([(2, True), (3, False), (5, None)], "id int, closed boolean")
    assert sorted(r.id for r in retrieval.recommendable(found, records).collect()) == [3, 5]


def test_top_k_takes_passes_and_keeps_ties(spark, monkeypatch):
    monkeypatch.setattr(dense, "PASS", 3)
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)], "id long, v array<double>, kind string")
    got = defaultdict(list)
    for r in dense.top_k(rows, rows.where("id < 8").select(F.col("id").alias("qid"), "v"), 4).collect():
        got[r.qid].append((r.score, r.id))
    for q in range(8):
        want = [sorted(((float(v[q] @ v[i]), i) for i in range(60) if i != q and i % 2 == kind), key=lambda x: (-x[0], x[1]))[:4] for kind in (0, 1)]
        assert sorted(got[q]) == sorted(want[0] + want[1])


def codes(spark, detect, text):
    return [(v.code, v.detail) for v in spark.createDataFrame([(text,)], "a string").select(detect(F.col("a")).alias("v")).first().v]


def test_detectors_on_known_answers(spark):
    halls = F.array(F.lit("Blue Hall"))
    booth = lambda a: grading.booth_refusal(a, halls)
    assert codes(spark, booth, "Booth numbers are not published.") == []
    assert codes(spark, booth, "Their booth is in Blue Hall.") == [("booth_placement_asserted", "booth is"), ("session_hall_presented_as_booth", "Blue Hall"), ("no_refusal_at_all", "")]
    assert codes(spark, booth, "I have no record of a stall.") == [("wrong_refusal_claim", "no record")]
    assert ("booth_identifier_emitted", "stall 14B") in codes(spark, booth, "Go to stall 14B")
    assert codes(spark, lambda a: grading.closed_door(a), "It is invite-only. Nothing more.") == []
    year = lambda a: grading.data_year(a, F.array(F.lit("old prize")))
    assert codes(spark, year, "In 2023 they won the old prize") == [("out_of_scope_fact_asserted", "old prize"), ("prior_edition_answered", "2023"), ("silent_on_missing_record", "")]
    assert codes(spark, year, "I have no record of 2023.") == []
    none = F.array().cast("array<string>")
    made_up = lambda a: grading.no_fabrication(a, F.lit("Kelp.io Ltd"), F.array(F.lit("website")), none, none)
    assert codes(spark, made_up, "No information; try kelp.io") == []
    assert codes(spark, made_up, "No information; try kelp-ropes.com") == [("invented_website", "kelp-ropes.com")]
    assert codes(spark, booth, None) == [("no_refusal_at_all", "")]


def test_filters_leave_out_what_they_do_not_speak_of(spark):
    rows = [("session", "Hall A", None, False), ("partner", None, "fin", None), ("speaker", None, None, None)]
    records = spark.createDataFrame(rows, "type string, hall string, sector string, closed boolean").selectExpr("*", "'2026-09-09' as day", "null as format", "null as track", "array('x') as topics", "array('Ann Low') as people", "'ann low' as name_key", "null as tier")
    kept = lambda f: [r.type for r in records.where(agenda.keep(f, F.array(F.lit("2026-09-09")))[0]).collect()]
    assert kept({}) == ["session", "partner", "speaker"] and kept({"hall": ["a hall"]}) == ["session"] and kept({"sector": ["fin"]}) == ["partner"]
    assert kept({"speaker": ["Dr. Ann Low"]}) == ["session", "speaker"] and kept({"day": ["day 2"]}) == [] and kept({"day": [1]}) == ["session"]
    assert kept({"track": ["x"]}) == ["session"] and kept({"type": ["speaker"], "speaker": ["Ann Low"]}) == ["speaker"]


def test_boosts_are_added_in_shares_of_bounded_rows(spark, monkeypatch):
    """Many hits are dealt to more tasks than the session's setting names; forms, which change no sum, are not shuffled."""
    rnd = random.Random(5)
    rows = [(rnd.randrange(40), rnd.randrange(3), f"f{i}", rnd.choice([0.1, 0.25, 0.25, 0.7])) for i in range(900)]
    want = defaultdict(list)
    for qid, i, _, boost in rows:
        want[qid, i].append(boost)
    monkeypatch.setattr(storage, "SHARE", 100)
    out = names.total(spark.createDataFrame(rows, "qid int, id int, form string, boost double"), len(rows))
    assert out.rdd.getNumPartitions() == 9 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r.qid, r.id): r.boost for r in out.collect()}
    assert got == pytest.approx({k: sum(b / i for i, b in enumerate(sorted(v, reverse=True), 1)) for k, v in want.items()})
