"""Stages that prepare a corpus, each over all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and
rereads it, so a lost executor costs at most the stage at hand. All stages but the last return the columns of documents, whatever
further columns there are and however they are named. An empty table stays empty at every stage; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, pieces, pii, quality_rules, simhash
from quern.llm.common import documents, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy of the quality rules keeps. Null and empty texts are too short and go; repeated rows and rows
    of one doc_id are judged one by one, so they stay or go alike."""
    return quality_rules.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, a null one last; ties go to the smaller hash of the row, and
    of rows alike in all columns one stays. Null, empty and blank texts are one group."""
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null texts stay null, repeated rows are treated alike, no row goes."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeats included; shards and slots order the draw and are not passed on. Null and empty texts are never taken; a null source is a source of its own; rows of one
    doc_id and size stand in order of a hash of the row, so reruns agree."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's ids, checked by decoding them. A null text has null ids; every row gives a row."""
    return pieces.encoded(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("pii", personal_data), ("mix_sources", mix), ("pieces", encode)]
ORACLE_SQL = None  # fingerprints, deobfuscation and Viterbi encoding are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
