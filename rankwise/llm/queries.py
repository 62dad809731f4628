"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankwise.llm import (
    bpe,
    common,
    conversation_trie,
    embeddings,
    fingerprints,
    license_scan,
    mixing,
    quality_rules,
    ranked_search,
    simhash,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filters,
)
from rankwise.sources.tables import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(common.documents(spark, sf_dir)))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(common.documents(spark, sf_dir))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(common.documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(common.documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(common.documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(common.documents(spark, sf_dir))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(common.documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(common.documents(spark, sf_dir))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.digest(table(spark, sf_dir, "embeddings"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(common.documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(common.documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.digest(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filters, op2_license_scan, op3_simhash_near_dedup, op4_suffix_array_dedup, op5_toxicity,
                            op6_document_fingerprints, op7_source_mixing, op8_bpe_encoding, op9_substring_dedup,
                            op10_embedding_near_dedup, op11_quality_rules, op12_ranked_search, op13_conversation_trie)}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": url_filters.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
    "op10_embedding_near_dedup": embeddings.ORACLE_SQL,
    "op12_ranked_search": ranked_search.ORACLE_SQL,
    "op13_conversation_trie": conversation_trie.ORACLE_SQL,
}
