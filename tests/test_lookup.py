"""Name scans, random indexing, strict CSV, feeds and question analysis against brute force and known results."""

import csv
import io
import json
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import analysis
from quern.functions import text as tx
from quern.operators import dense, names, random_index, terms
from quern.plans import lookup, registry
from quern.sources import exports, records
from quern.sources.tables import table

SF = "/root/testdata/sf0.001"


def as_numpy(vec):
    out = np.zeros(random_index.DIMENSIONS)
    for x in vec:
        out[x["dim"]] = x["v"]
    return out


def brute_scan(tokens, stem, forms):
    at, found = 0, []
    while at < len(tokens):
        for n in range(min(names.LONGEST, len(tokens) - at), 0, -1):
            options = [" ".join(tokens[at : at + n])] + ([stem[at]] if n == 1 else [])
            hit = next((f for f in options if f in forms), None)
            if hit:
                found.append((hit, n))
                at += n
                break
        else:
            at += 1
    return found


def test_scan_by_brute_force(spark):
    lex = lookup.lexicon_of(lambda n: table(spark, SF, n))
    forms = {}
    for r in lex.collect():
        forms.setdefault(r.form, []).append((r.id, r.kind))
    docs = table(spark, SF, "documents").select("doc_id", tx.tokens("text", keep_stopwords=True).alias("k"))
    rows = docs.select("doc_id", "k", F.transform("k", tx.stem_plural).alias("s"), names.capitalised(F.lit("x")).alias("c")).collect()
    want: Counter = Counter()
    for r in rows:
        for form, n in brute_scan(r.k, r.s, forms):
            for i, kind in forms[form]:
                assert form not in names.COMMON_NAMES
                want[r.doc_id, i] += names.KIND_WEIGHT[kind] * (1 + 0.35 * (n - 1)) / math.sqrt(len(forms[form]))
    got = {(r.qid, r.id): r.boost for r in registry.QUERIES["name_scan"](spark, SF).collect()}
    assert got and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_scan_of_known_names(spark):
    forms = spark.createDataFrame([("jp morgan", "a", "primary"), ("jp morgan", "b", "associated"), ("morgan stanley", "c", "primary"), ("raise", "d", "primary"), ("raise", "d", "primary"), ("of", "e", "primary"), (" ", "f", "primary"), ("pay", "g", "primary")], "form string, id string, kind string")
    lex = names.lexicon(forms, spark.createDataFrame([("pay", 7), ("raise", 6)], "term string, df long"))
    assert {r.form for r in lex.collect()} == {"jp morgan", "morgan stanley", "raise"}
    texts = spark.createDataFrame([(1, "jp Morgan Stanley raise"), (2, "we met Raise"), (3, None), (4, "")], "qid long, text string")
    got = {(r.qid, r.id): r.boost for r in names.scan(texts, lex).collect()}
    assert got == {(1, "a"): pytest.approx(1.35 / math.sqrt(2)), (1, "b"): pytest.approx(0.6 * 1.35 / math.sqrt(2)), (1, "d"): 0.25, (2, "d"): 1.0}


def test_small_lexicon_goes_to_the_texts(spark):
    texts = spark.createDataFrame([(1, "one two three")], "qid long, text string")
    lex = spark.createDataFrame([("one two", 7, "primary")], "form string, id long, kind string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = names.scan(texts, lex)
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString() and [r.form for r in found.collect()] == ["one two"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


ODD_TEXTS = [
    None, "", "  \t ", "The dogs' dog's dog's. churches, Berries & glass; AT&T ***stars***", "don't rock'n'roll 'tis x'' (s's) \u2018Quoted\u2019s\u201d",
    "\u00dcber stra\u00dfe \u00c9COLES \u00f1o\u00f1os\u00a0nbsp\u2026 caf\u00e9s \u0130stanbul \u212aelvins", "dog's\u2028 cats'\x85 a\x1cb a\x0bb\x0cc\rd\ne", "\u65e5\u672c buses gas ties pies 1,000s a-b-c state-of-the-art's &&& .,;",
    "\U0001f600smiles\U0001f600 \u03a3\u03a3s o\u0308s x_y=z's`s", "yes the 7 q s as us is os oars lashes foxes zes ies aies",
]


def test_texts_are_cut_as_tokens_are(spark):
    """Terms that each distinct chunk of a batch is cut into are what the column function gives, whatever stands in the texts."""
    rng = np.random.default_rng(5)
    signs = list("aeSs'’ &.-,ÉßñI\u00a0\u2028\x85\x1c\t\n1y")
    texts = ODD_TEXTS + ["".join(rng.choice(signs, 24)) for _ in range(600)]
    for keep in (True, False):
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, x string").select("id", tx.tokens("x", keep_stopwords=keep).alias("k")).collect()
        found, doc, number = terms.read(pa.array(texts, pa.string()), keep)
        got = [[] for _ in texts]
        for d, i in zip(doc, number, strict=True):
            got[d].append(found[int(i)].as_py())
        assert {r.id: list(r.k) for r in rows} == dict(enumerate(got))


def test_frequencies_without_a_row_for_each_text_and_term(spark, monkeypatch):
    texts = spark.createDataFrame([(x,) for x in [*ODD_TEXTS, "a b a", "b"]], "text string").coalesce(1)
    want = Counter(t for r in texts.select(tx.tokens("text", keep_stopwords=True).alias("k")).collect() for t in set(r.k))
    for most in (terms.SLICE, 8):
        monkeypatch.setattr(terms, "SLICE", most)
        found = terms.frequencies(texts, keep_stopwords=True)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString() and {r.term: r.df for r in found.collect()} == want
    assert "Generate" not in lookup.lexicon_of(lambda n: table(spark, SF, n))._jdf.queryExecution().executedPlan().toString().split("documents.parquet")[-1]


def test_scan_makes_no_n_grams_of_texts(spark, monkeypatch):
    """Texts follow a small lexicon and give what the join of their n-grams with it gives."""
    made = [("one", 1), ("one two", 2), ("one two three four five six", 3), ("one two three four five six seven", 4), ("berry", 5), ("two one", 6), ("wave", 7), ("wave", 8), ("wave dog", 9), ("x  y", 10), ("cafe", 11)]
    lex = spark.createDataFrame([(f, i, "primary") for f, i in made], "form string, id long, kind string")
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["one", "two", "Two", "berries", "wave", "Wave", "WAVES", "dog's", "caf\u00e9s,", "&", "x"], 9)) for _ in range(80)]
    texts += [None, "", "one two three four five six seven", "one two three four five one two", "ALL WAVE"]
    frame = spark.createDataFrame([*enumerate(texts), (None, "one two")], "qid long, text string")
    found = names.scan(frame, lex)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "flatten" not in plan and "collect_list" not in plan
    got = Counter((r.qid, r.form, r.id, r.kind, r.boost) for r in found.collect())
    monkeypatch.setattr(names, "SMALL_LEXICON", 0)
    assert got and got == Counter((r.qid, r.form, r.id, r.kind, r.boost) for r in names.scan(frame, lex).collect())


def test_capitalised(spark):
    got = spark.createDataFrame([("Tell me of Raise and Sarvam.ai",), ("LOUD RAISE",), (None,)], "x string").select(names.capitalised("x").alias("c")).collect()
    assert [sorted(r.c) for r in got] == [["raise", "sarvamai"], [], []]


def test_random_indexing_by_brute_force(spark):
    docs = {"d1": "a a b", "d2": "b c", "d3": "c c c d", "d4": "d"}
    postings = [(d, t, k) for d, x in docs.items() for t, k in Counter(x.split()).items()]
    weighted = random_index.weights(spark.createDataFrame(postings, "id string, term string, tf long"))
    terms = random_index.term_vectors(weighted)
    df = Counter(t for _, t, _ in postings)
    w = {(d, t): (1 + math.log(k)) * math.log(1 + len(docs) / (df[t] + 0.5)) for d, t, k in postings}
    index = {d: as_numpy([{"dim": i, "v": s} for i, s in random_index.index_vector(d).items()]) for d in docs}
    assert all(np.abs(v).sum() == random_index.SPARSITY for v in index.values())
    unit = lambda v: v / np.linalg.norm(v)
    want_t = {t: unit(sum(x * index[d] for (d, u), x in w.items() if u == t)) for t in df}
    want_d = {d: unit(sum(x * want_t[t] for (e, t), x in w.items() if e == d)) for d in docs}
    for r in terms.collect():
        assert np.allclose(as_numpy(r.vec), want_t[r.term])
    for r in random_index.compose(weighted, terms).collect():
        assert np.allclose(as_numpy(r.vec), want_d[r.id])
    near = random_index.neighbours(terms, spark.createDataFrame([("a",)], "term string"), 1).collect()
    assert near[0].other == max((t for t in want_t if t != "a"), key=lambda t: want_t[t] @ want_t["a"])


def test_random_indexing_of_all_documents(spark, monkeypatch):
    """Passes over frequent terms and links of rare ones give what sums of sparse rows give, without a row for each posting and dimension."""
    ids = ["7", "d1", "long id", "é", "\U0001f600"]
    at, sign = random_index.index_vectors(ids)
    assert [dict(zip(a.tolist(), s.tolist(), strict=True)) for a, s in zip(at, sign, strict=True)] == [random_index.index_vector(x) for x in ids]
    rng = np.random.default_rng(3)
    rows = [(d, f"w{w}", int(k)) for d in range(60) for w, k in Counter(np.minimum(rng.zipf(1.3, 25), 90).tolist()).items()]
    postings = spark.createDataFrame(rows, "id long, term string, tf long").coalesce(1)
    weighted = random_index.weights(postings)
    want = {r.id: as_numpy(r.vec) for r in random_index.compose(weighted, random_index.term_vectors(weighted)).collect()}
    for most in (random_index.PASS, 2):
        monkeypatch.setattr(random_index, "PASS", most)
        made = random_index.documents(postings)
        got = {r.id: np.array(r.v) for r in made.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[d], want[d], atol=1e-6) for d in want)
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_random_indexing_of_texts(spark, monkeypatch):
    """Texts are read where they lie, slice by slice; texts of one id are one document."""
    rng = np.random.default_rng(4)
    words = lambda: " ".join(f"w{w}," for w in np.minimum(rng.zipf(1.3, 25), 90))
    rows = [(d, words()) for d in range(60)] + [(7, words()), (7, None), (90, None), (91, "the of"), (92, "")]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    tf = Counter((d, w) for d, x in rows for w in (x or "").replace(",", "").split() if w not in ("the", "of"))
    postings = spark.createDataFrame([(d, w, k) for (d, w), k in sorted(tf.items())], "id long, term string, tf long").coalesce(1)
    weighted = random_index.weights(postings)
    want = {r.id: as_numpy(r.vec) for r in random_index.compose(weighted, random_index.term_vectors(weighted)).collect()}
    for most, rare, size in ((random_index.PASS, 16, terms.SLICE), (7, 2, 300), (3, 1000, 300)):
        monkeypatch.setattr(random_index, "PASS", most)
        monkeypatch.setattr(random_index, "FETCH", most)
        monkeypatch.setattr(random_index, "RARE", rare)
        monkeypatch.setattr(random_index, "SHARE", 4)
        monkeypatch.setattr(terms, "SLICE", size)
        got = {r.id: np.array(r.v) for r in random_index.of_texts(texts).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[d], want[d], atol=1e-6) for d in want)
    assert random_index.of_texts(texts.where("id > 95")).count() == 0


@pytest.mark.parametrize(("rows", "batch"), [(5, 3), (900, 100), (900, 10_000)])
def test_nearest_in_single_precision_is_exact(spark, monkeypatch, rows, batch):
    """Copies, near copies, opposite and far vectors, the row itself left out: what `top_k` gives with all scores in double precision."""
    rng = np.random.default_rng(rows)
    v = rng.normal(size=(rows, 64))
    v[rng.integers(0, rows, rows // 2)] = v[0]
    v[rng.integers(0, rows, rows // 4)] = v[0] + rng.normal(size=64) * 1e-5
    v[1] = -v[0]
    v = (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(3).localCheckpoint()
    asked = frame.where("id % 4 < 2").withColumnRenamed("id", "qid")
    exact = v.astype(np.float64) / np.sqrt((v.astype(np.float64) ** 2).sum(1, keepdims=True))
    doubles = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(exact)], "id long, v array<double>")
    want = {tuple(r) for r in dense.top_k(doubles, doubles.where("id % 4 < 2").withColumnRenamed("id", "qid"), 3, digits=9).collect()}
    monkeypatch.setattr(dense, "GRID_ROWS", batch)
    assert {tuple(r) for r in dense.nearest(frame, asked, 3, 9).collect()} == want and len(want) == 3 * asked.count()
    monkeypatch.setattr(dense, "PASS_BYTES", 1 << 14)
    assert {tuple(r) for r in dense.nearest(frame, asked, 3, 9).collect()} == want
    assert dense.nearest(frame, asked.where("qid < 0"), 3, 9).count() == 0


def test_random_indexing_query(spark):
    got = registry.QUERIES["random_indexing"](spark, SF).collect()
    assert got and all(r.doc_id % 100 == 0 and r.other != r.doc_id and -1.001 <= r.similarity <= 1.001 for r in got)


def test_questions(spark):
    asked = [("looking for partners in lending",), ("someone to meet",), ("a keynote on day 2",), (None,)]
    got = [r.a for r in spark.createDataFrame(asked, "x string").select(analysis.analyse("x").alias("a")).collect()]
    assert [(t.term, t.weight) for t in got[0].terms] == [("lending", 1.0)] and got[0].hints == ["partner"]
    assert [t.weight for t in got[1].terms] == [0.3] * len(got[1].terms) and got[1].dropped == []
    assert got[2].day == "2" and "keynote" in [t.term for t in got[2].terms] and got[2].hints == ["session"]
    assert got[3].terms == [] and got[3].day is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a,"\r\n ;', max_size=6), min_size=2, max_size=3), min_size=1, max_size=4))
def test_strict_reader_round_trip(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n", quoting=csv.QUOTE_ALL).writerows(rows)
    assert exports.parse_strict(out.getvalue()) == rows


@pytest.mark.parametrize("bad", ['a,b"c\r\n', 'a,"b', "a\nb", "a\rb", '"a"b,c'])
def test_strict_reader_refuses(bad):
    with pytest.raises(ValueError):
        exports.parse_strict(bad)


def test_findings(spark):
    b = exports.BOM
    files = [(1, f"{b}a,b\r\n1,2\r\n"), (2, "a,a\r\n1\r\n"), (3, f'{b}a,booth\r\nx,"NaN"\r\n'), (4, f'{b}a,"b'), (5, None)]
    got = spark.createDataFrame(files, "i int, t string").withColumn("p", exports.parsed("t")).select("i", exports.findings("t", "p", ("booth",)).alias("f")).collect()
    assert {r.i: r.f for r in got} == {1: [], 2: ["duplicate-header", "no-bom", "ragged"], 3: ["banned-column", "placeholder"], 4: ["malformed"], 5: ["no-bom"]}


def test_csv_and_lines_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x "y", z', ["p", "q"], True), (2, None, [], False)], "id int, t string, a array<string>, b boolean").coalesce(1)
    exports.write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part*")).read_bytes().decode()
    assert text == exports.BOM + 'id,t,a,b\r\n1,"x ""y"", z",p;q,true\r\n2,,,false\r\n'
    exports.write_lines(df, str(tmp_path / "lines"))
    assert records.read_lines(spark, str(tmp_path / "lines")).where("skip = 'unknown-type'").count() == 2


def test_feeds(spark, tmp_path):
    (tmp_path / "partners.json").write_text(json.dumps([{"name": "A"}, {"name": "B"}]))
    got = records.read_folder(spark, str(tmp_path), {"partners": "name string", "speakers": "name string"})
    assert got["partners"].count() == 2 and got["speakers"].count() == 0
    with pytest.raises(FileNotFoundError):
        records.read_folder(spark, str(tmp_path), {"none": "name string"})
    lines = records.parse_lines(spark.createDataFrame([("{}",), ("  ",)], "value string"))
    assert records.choose(lines, got["partners"]).count() == 2 and records.choose(None, got["partners"]).count() == 2
    html = '<script>self.__next_f.push([1,"{\\"k\\": "])</script><script>self.__next_f.push([1,"[1, 2]} tail"])</script>'
    blob = spark.createDataFrame([(html,), ("none",), (None,)], "h string").select(records.payload("h").alias("b"))
    assert [r.v for r in blob.select(records.grab("b", "k").alias("v")).collect()] == ["[1,2]", None, None]
