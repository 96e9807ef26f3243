import numpy as np
import xxhash

from quern.llm import simhash
from quern.operators import identity
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def brute(rows):
    fps = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        value = 0
        for bit in range(64):
            ones = sum(xxhash.xxh64_intdigest(g, seed=42) >> bit & 1 for g in grams)
            value |= (2 * ones > len(grams)) << bit if grams else 0
        fps.append(value)
    return fps


def reach(ids, fps, most=3):
    arr, parent = np.array(fps, dtype=np.uint64), list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    for i in range(len(arr)):
        for j in np.nonzero(np.bitwise_count(arr ^ arr[i]) <= most)[0]:
            parent[find(int(j))] = find(i)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(ids))]


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same(docs):
    rows = rows_of(docs)
    fps = brute(rows)
    want = sorted(zip([str(r[0]) for r in rows], (f"{f:016x}" for f in fps), map(str, reach([r[0] for r in rows], fps)), strict=True))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in simhash.op10(docs).collect()) == want


def test_documents(spark):
    same(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_and_empty(spark):
    same(cases.odd(spark))
    assert simhash.op10(cases.empty(spark)).count() == 0


def test_links_find_every_pair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 5), replace=False)) for b in base for _ in range(25)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert want and {tuple(r) for r in simhash.links(frame).collect()} == want
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 3)  # all shared variants take the second cut
    assert {tuple(r) for r in simhash.links(frame).collect()} == want


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = dict(simhash.components(edges).collect())
    assert {found[i] for i in range(41)} == {0} and found[101] == found[100] == 100


def test_nothing_that_grows_is_broadcast(spark):
    texts = ["one two three four five six seven eight nine ten"] * 3 + ["one two three four five six seven eight nine eleven", "other words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ran = spark._jsparkSession.sharedState().statusStore()
    before = ran.executionsCount()
    simhash.deduplicated(docs).collect()
    simhash.cluster(docs).collect()
    identity.components(spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a long, b long")).collect()
    plans = ran.executionsList()
    assert plans.size() > before
    assert not any("BroadcastHashJoin" in plans.apply(i).physicalPlanDescription() for i in range(before, plans.size()))
