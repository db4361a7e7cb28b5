"""One query per operator, over its whole table with production parameters, and its SQL where SQL can say the same."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (exact_dedup, language_id, mixing, packing, pii, prefix_trie, quality_classifier, quality_rules, simhash, spelling,
               token_counts, token_files, vector_search)
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draws(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_digests(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), every=50)


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_temperature_mixing, op3_token_counts, op4_exact_dedup, op5_quality_classifier, op6_simhash, op7_pii,
    op8_packing, op9_language_id, op10_token_files, op11_prefix_trie, op12_spelling_variants, op13_vector_search)}
ORACLES = {"op1_quality_rules": quality_rules.QUERY_SQL, "op2_temperature_mixing": mixing.QUERY_SQL, "op4_exact_dedup": exact_dedup.QUERY_SQL,
           "op13_vector_search": vector_search.QUERY_SQL}
