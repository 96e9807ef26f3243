"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import hashlib
import os
import re

import duckdb
import pytest

from quern.plans import agenda, catalogue, partners, planning, registry, search
from quern.plans.declare import hashed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(names, found):
    norm = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([norm(r[i]) for i in at]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", ["chunk_texts", "session_people", "session_speakers"])
def test_sessions_are_read_once(spark, monkeypatch, name):
    """Plans that need the sessions for the directory too extract them from the raw agenda once."""
    asked = []
    known = agenda.raw_sessions
    monkeypatch.setattr(agenda, "raw_sessions", lambda t: asked.append(1) or known(t))
    registry.QUERIES[name](spark, SF)
    assert asked == [1]


def test_clash_filter_is_greedy(spark):
    events = {r.event_id: r for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    slot = lambda i: ((s := int(events[i].ts.timestamp() // 60)), s + 20 + i % 40)
    kept: dict = {}
    for i in sorted(events):
        s, e = slot(i)
        mine = kept.setdefault((events[i].user_id, s // 1440), [])
        if all(e <= a or b <= s for _, a, b in mine):
            mine.append((i, s, e))
    want = sorted((u, d, i) for (u, d), xs in kept.items() for i, _, _ in xs)
    assert sorted(map(tuple, registry.QUERIES["clash_filter"](spark, SF).collect())) == want


def test_chunks_by_brute_force(spark):
    """Whole sentences in order, at most 220 words unless one sentence has more, each chunk beginning with the last sentence of the one before."""
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        sentences = [s for s in re.split(r"(?<=[.!?]) ", re.sub(r"[ \t-\r]+", " ", r.text)) if s]
        chunks, at = [[]], 0
        for s in sentences:
            if at and at + len(s.split(" ")) > 220:
                chunks.append([chunks[-1][-1]])
                at = len(chunks[-1][0].split(" "))
            chunks[-1].append(s)
            at += len([w for w in re.split(" +", s)])
        want |= {(r.doc_id, i): " ".join(c) for i, c in enumerate(chunks)}
    got = {(r.doc_id, r.part): r.chunk for r in registry.QUERIES["chunk_documents"](spark, SF).collect()}
    assert got == want


def test_rate_limit_by_brute_force(spark):
    seen: dict = {}
    want = {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (int(r.ts.timestamp()), r.event_id)):
        start, n = seen.get(r.user_id, (None, 0))
        s = int(r.ts.timestamp())
        start, n = (s, 0) if start is None or s - start >= 3600 else (start, n)
        seen[r.user_id] = (start, n + 1)
        want[r.event_id] = n + 1 <= 3
    assert {r.event_id: r.allowed for r in registry.QUERIES["rate_limit"](spark, SF).collect()} == want


def test_digests_go_round_beyond_a_long(spark):
    n = 90_000
    got = spark.range(n).agg(hashed("id").alias("h")).first().h
    want = sum(int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) for i in range(n))
    assert want >= 1 << 63 and got == (want + (1 << 63)) % (1 << 64) - (1 << 63)
    assert spark.range(0).agg(hashed("id").alias("h")).first().h is None


def test_gates_list_every_case(spark):
    rows = [(5, 0.1), (5, 0.01), (10, 0.1), (10, 0.1), (15, 0.1), (20, 0.0), (1, 0.0), (2, None)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_discount double")
    got = {tuple(r[c] for c in ("rule", "passed", "ok", "failed", "flaky")) for r in planning.gate_lists(lambda name: lines).collect()}
    assert got == {(0, 1, False, 5, 5), (0, 1, False, 10, None), (0, 1, False, 15, None), (1, 1, True, None, None), (2, 0, None, None, None)}


def test_phrase_tags_beyond_ascii(spark):
    texts = ["Räder", "éthe", "theé", "söden", "the_", "ſthe", "abcdefghijkſ", "ABCDEFGHIJKL", "abcdefghijkı", "und\nden", "İthe", "ANDß", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    got = {r.doc_id: r.tags for r in partners.phrase_tags(lambda name: docs).collect()}
    assert got == dict(con.execute(f"select doc_id, tags from ({registry.ORACLE['phrase_tags']})").fetchall())


@pytest.mark.parametrize("name", ["dense_topk", "more_like_this", "index_search"])
def test_rounding_makes_ties(spark, name):
    at = lambda x: [x, (1 - x * x) ** 0.5] + [0.0] * 62
    rows = [(0, 1, at(1.0)), *((i, 1, at(0.5 + i * 1e-9)) for i in range(1, 40, 2)), (41, 1, at(0.0999997)), (43, 1, at(0.0999994))]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, label int, embedding double[])")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    want = con.execute(f"select qid, id, rank from ({registry.ORACLE[name]})").fetchall()
    got = getattr(search, name)(lambda _: table).select("qid", "id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 5


def test_followups_of_stop_words(spark):
    rows = [(1, 1, "user", "The on by and."), (1, 2, "user", "x"), (1, 3, "user", None), (1, 5, "user", "and more"), (1, 6, "bot", "no"), (2, 1, "user", "a"), (3, 1, "user", None), (3, 3, "user", ""), (4, 0, "user", "logistics not")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = catalogue.followup_rewrite(lambda _: table).select("conv_id", "turn", "prefixed_by").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(f"select conv_id, turn, prefixed_by from ({registry.ORACLE['followup_rewrite']})").fetchall()))
