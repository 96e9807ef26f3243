from collections import defaultdict

import corpus_pipeline
from quern.llm import mixing, pieces, pii, quality_rules
from quern.llm.common import materialise
from tests.llm import cases
from tests.llm.test_simhash import brute, reach

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = materialise(corpus_pipeline.quality(spark, docs, SF), "kept")
    book = {r.doc_id: r.kept for r in quality_rules.op1(docs).collect()}
    assert kept.columns == COLUMNS and key(kept.collect()) == key(r for r in docs.collect() if book[r.doc_id])

    one = materialise(corpus_pipeline.near_dedup(spark, kept, SF), "one")
    rows = kept.collect()
    groups = defaultdict(list)
    for r, c in zip(rows, reach([r.doc_id for r in rows], brute([(r.doc_id, r.text) for r in rows])), strict=True):
        groups[c].append(r)
    assert one.columns == COLUMNS and key(one.collect()) == key(min(g, key=lambda r: r.doc_id) for g in groups.values())

    clean = materialise(corpus_pipeline.personal_data(spark, one, SF), "clean")
    want = {r.doc_id: pii.redact(r.text) for r in one.collect()}
    assert clean.columns == COLUMNS and {r.doc_id: r.text for r in clean.collect()} == want
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    mixed = materialise(corpus_pipeline.mix(spark, clean, SF), "mixed")
    taken = {r.doc_id: r.taken for r in mixing.op4(clean).collect()}
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert set(r.text.encode().split()) <= set(want[r.doc_id].encode().split())
    assert mixed.columns == COLUMNS and dict(words) == {d: n for d, n in taken.items() if n}

    vocab = pieces.Pieces(pieces.default_vocabulary())
    coded = corpus_pipeline.encode(spark, mixed, SF).collect()
    assert all(r.same for r in coded) and len(coded) == mixed.count()
    texts = sorted(r.text for r in mixed.collect())
    assert sorted(vocab.decode(pieces.np.array(r.ids, "<u4").tobytes()) for r in coded) == texts


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("not same").count() == 0


def test_odd_and_empty(spark):
    odd = cases.odd(spark)
    one = materialise(corpus_pipeline.near_dedup(spark, odd, SF), "one")
    assert one.columns == odd.columns
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "10", "11", "3", "6", "7", "8", "9", "None"]
    assert corpus_pipeline.quality(spark, odd, SF).columns == odd.columns
    docs, empty = odd, cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs, empty = materialise(stage(spark, docs, SF), "odd"), materialise(stage(spark, empty, SF), "odd")
        assert docs.count() >= 0 and empty.count() == 0
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, odd, SF).count() > 0


def test_each_stage_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing, dotted and map-typed names."""
    odd = cases.odd(spark).selectExpr("*", "map('k', 1) as m", "1 as `a.b`", "2 as `doc`", "'x' as `tie`", "3 as `row`", "4 as `part`")
    rows = odd.select("doc_id", "text", "source").collect()
    quality = corpus_pipeline.quality(spark, odd, SF)
    assert quality.columns == odd.columns and [r.doc_id for r in quality.collect()] == []  # all are too short, too long-worded or repetitive
    one = corpus_pipeline.near_dedup(spark, odd, SF)
    assert one.columns == odd.columns and sorted(str(r.doc_id) for r in one.select("doc_id").collect()) == ["1", "10", "11", "3", "6", "7", "8", "9", "None"]
    clean = corpus_pipeline.personal_data(spark, odd, SF)
    assert clean.columns == odd.columns and sorted(str(r.text) for r in clean.select("text").collect()) == sorted(str(r.text) for r in rows)
    mixed = corpus_pipeline.mix(spark, odd, SF)
    taken = mixed.select("doc_id", "text", "source").collect()
    assert mixed.columns == odd.columns and taken and {str(r.doc_id) for r in taken} <= {str(r.doc_id) for r in rows if r.text and r.text.split()}
    assert sorted(map(str, taken)) == sorted(map(str, corpus_pipeline.mix(spark, odd.repartition(5), SF).select("doc_id", "text", "source").collect()))
    coded = corpus_pipeline.encode(spark, odd, SF).collect()
    assert len(coded) == len(rows) and all(r.same for r in coded)
