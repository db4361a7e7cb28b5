"""The corpus pipeline: language ID, exact de-duplication, SimHash near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatelake.llm import exact_dedup, language_id, mixing, packing, simhash
from gatelake.llm.common import stored, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language stay; text in no learned language, or without a letter, goes."""
    return language_id.keep_identified(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays, that with the smallest doc_id, nulls last, then by text hash."""
    return simhash.drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix draws it; a row drawn twice is there twice."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the mixed documents, placed in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language id", identified), ("exact dedup", distinct_texts), ("simhash near-dedup", distinct_fingerprints),
          ("source mixing", mixed_sources), ("best-fit packing", packed_sequences)]
#: Token ids, fingerprints and a trained model are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written as Parquet and read again as the next one's input."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
