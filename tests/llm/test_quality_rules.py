from collections import Counter

import duckdb
import pytest

from quern.llm import quality_rules as qr
from tests.llm import cases

HOT = [(100 + i, "spam line\nspam line\n" * 40, "en", "hot", 1) for i in range(60)] + [(200 + i, "SHOUT " * 60 + str(i), "en", "hot", 1) for i in range(20)]


def rows(docs):
    return sorted(map(str, map(tuple, qr.op1(docs).collect())))


def sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    return sorted(map(str, con.execute(qr.ORACLE).fetchall()))


def test_documents_equal_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(docs) == sql(docs)


@pytest.mark.parametrize("n", range(len(cases.ODD)))
def test_odd_rows_equal_sql(spark, n):
    docs = spark.createDataFrame([cases.ODD[n]], cases.SCHEMA)
    if cases.ODD[n][0] is not None:  # the SQL joins on doc_id
        assert rows(docs) == sql(docs)
    assert len(rows(docs)) == 1


def test_hot_groups_equal_sql(spark):
    docs = spark.createDataFrame(HOT, cases.SCHEMA)
    assert rows(docs) == sql(docs)


def test_odd_and_empty(spark):
    assert qr.op1(cases.odd(spark)).count() == len(cases.ODD)
    assert qr.op1(cases.empty(spark)).count() == 0
    kept = qr.accepted(cases.odd(spark))
    assert kept.columns == cases.odd(spark).columns and qr.accepted(cases.empty(spark)).count() == 0


def test_accepted_are_those_that_op1_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(r.doc_id for r in qr.op1(docs).where("kept").collect())
    assert sorted(r.doc_id for r in qr.accepted(docs).collect()) == want and want


def test_policies_read_the_same_ledger(spark):
    book = qr.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).cache()
    names = list(qr.RULES)
    for policy in (qr.BASE, qr.PRODUCTION, qr.Policy("none", ()), qr.Policy("one", ("shouting",))):
        mask = sum(1 << names.index(r) for r in policy.rules)
        for r in qr.apply_policy(book, policy).collect():
            assert r.kept == (r.fail_bits & mask == 0) and r.policy == policy.version


def test_ablation_by_brute_force(spark):
    docs = spark.createDataFrame(HOT, cases.SCHEMA).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    book = qr.ledger(docs)
    bits = [r.fail_bits for r in book.collect()]
    names = list(qr.RULES)
    for policy in (qr.PRODUCTION, qr.BASE):
        want = {}
        for rule in policy.rules:
            bit = 1 << names.index(rule)
            others = policy.mask & ~bit
            want[rule] = (sum(b & bit != 0 for b in bits), sum(b & bit != 0 and b & others == 0 for b in bits), sum(b & others == 0 for b in bits))
        assert {r.rule: (r.fails, r.only_this, r.kept_without) for r in qr.ablation(book, policy).collect()} == want
    assert Counter(b & 1 for b in bits)[1] > 0
