import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import divergence as dv
from tests.llm import cases


def brute(rows, least, top):
    seen, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        seen[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        own = sorted(s for x, s in groups if x == lang)
        count = {s: np.array([seen[lang, s][t] for t in kept], dtype=object) for s in own}
        share = lambda c: [1 + (10**9 * (x + 5)) // (sum(c) + 5 * len(kept)) for x in c]
        p, q = {s: share(count[s]) for s in own}, share(sum(count.values()))
        for s in own:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in own if o != s]
            terms = [(p[s][i] - q[i], t) for i, t in enumerate(kept) if count[s][i] and p[s][i] > q[i]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, n + 1) for n, (value, item) in enumerate(ranked)]
    return sorted(out)


def check(spark, docs, least=2, top=3, bounds=dv.Bounds()):
    rows = [(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]
    got = sorted(map(tuple, dv.audit(docs, least, top, bounds).collect()))
    assert got == brute(rows, least, top)
    return got


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len(check(spark, docs.repartition(5), 3, 4)) > 300


def test_odd_and_empty(spark):
    docs = cases.odd(spark)
    check(spark, docs.unionByName(docs), 2, 50)
    check(spark, docs, 1, 2)
    assert check(spark, docs, 1000)  # pairs alone, all of value 0
    assert dv.op13(cases.empty(spark)).count() == 0


def test_small_bounds_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").repartition(3)
    assert check(spark, docs, 3, 4) == check(spark, docs, 3, 4, dv.Bounds(counts=200, leaves=5, range=40, block=50, cells=40, tile=3, rows=7))


def test_hot_source_and_ties(spark):
    rows = [("same word again", "en", "hot")] * 60 + [(f"same tie{chr(97 + i % 26)} ätie 語", "en", f"s{i % 7}") for i in range(80)] + [("Zz zz ZZ", None, None)] * 3
    check(spark, spark.createDataFrame(rows, "text string, lang string, source string"), 2, 3)


def test_shares_are_exact_for_large_counts():
    counts, totals = np.array([[0, 1 << 40, (1 << 50) + 3]]), np.array([[1 << 52] * 3])
    assert dv.shares(counts, totals, 7).tolist() == [[1 + 10**9 * (int(c) + 5) // ((1 << 52) + 35) for c in counts[0]]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abcä語", min_size=1, max_size=7), st.sampled_from("xyz")), min_size=1, max_size=80), st.integers(1, 9))
def test_containers_are_the_trie_in_order(found, most):
    docs, sources = Counter(t.encode() for t, _ in found), defaultdict(Counter)
    for t, s in found:
        sources[s][t.encode()] += 1
    trie = dv.Trie(docs, sources)
    nodes = list(trie.containers(most))
    assert [n[1] for n in nodes] == [0, *[n[2] for n in nodes[:-1]]] and nodes[-1][2] == len(trie.terms) and all(0 < hi - lo <= most for _, lo, hi in nodes)
    assert all(t.startswith(prefix) for prefix, lo, hi in nodes for t in trie.terms[lo:hi])
    assert [t.decode() for t in trie.terms] == sorted({t for t, _ in found}, key=str.encode)
    for i, t in enumerate(trie.terms):
        at = slice(trie.ends[i - 1] if i else 0, trie.ends[i])
        assert {trie.sources[k]: n for k, n in zip(trie.which[at], trie.counts[at], strict=True)} == {s: c[t] for s, c in sources.items() if c[t]}


def test_a_common_prefix_takes_several_ranges():
    cuts = np.array([dv._keys([b"commonprefix"])[0]] * 4 + [dv._keys([b"x"])[0]])
    terms = [b"commonprefix%d" % i for i in range(200)]
    assert set(dv._ranges(terms, cuts)) == {1, 2, 3, 4} and dv._ranges([b"a", b"d", b"x", b"y"], cuts).tolist() == [0, 4, 5, 5]
