"""The queries of the operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import divergence, hard_negatives, language_model, link_trust, media, mixing, pieces, pii, quality_model, quality_rules, simhash, token_store, toxicity
from quern.llm.common import documents, input_table, labels


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op1(documents(spark, sf_dir))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each production rule rejects, alone and with the others, from the ledger's bits."""
    return quality_rules.ablation(quality_rules.ledger(documents(spark, sf_dir)), quality_rules.PRODUCTION)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.op3(documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4(documents(spark, sf_dir))


def op5_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op5(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op6(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op7(documents(spark, sf_dir))


def op8_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op8(documents(spark, sf_dir))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.op9(documents(spark, sf_dir))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op10(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op11(input_table(spark, sf_dir, "embeddings"))


def op12_url_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.op12(input_table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op13(documents(spark, sf_dir))


OPERATORS = (
    op1_quality_rules, op2_toxicity, op3_language_model, op4_mix_sources, op5_pii_deobfuscation, op6_quality_classifier, op7_pieces, op8_media_avi,
    op9_token_store, op10_simhash_near_dedup, op11_hard_negatives, op12_url_link_trust, op13_source_divergence, quality_ablation,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_url_link_trust": link_trust.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
    "quality_ablation": quality_rules.ABLATION_ORACLE,
}
