"""A training corpus from raw documents in five stages: language ID, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept, written as Parquet and read again.
All but the last return the columns of `docs` as they are, whatever further ones there are and however they are named.
Rows are told apart by doc_id and text, so that what happens to one row of a repeated or null doc_id doesn't happen to
another; rows repeated whole are one document after the second stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyscope.llm.common import materialize
from tallyscope.llm.decontaminate import drop_contaminated
from tallyscope.llm.digest_index import dedup_once, keep_first
from tallyscope.llm.langid import keep_identified
from tallyscope.llm.mixing import curriculum_mix, in_training_order
from tallyscope.llm.ngram_join import keep_representatives
from tallyscope.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts and those without a letter go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id (a null one is the smallest); null counts as empty."""
    return keep_first(docs, dedup_once(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents, the one with the smallest doc_id (a null one is the largest);
    of an id with several such texts the one with the least hash. Texts without words stay."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage of 8 characters or more stands, whole or in a long part; null texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often, and at which training positions, the mix takes each document: one row for each, also for those it takes
    no copy of (copies 0, no position). Null texts have size 0, a null source is one of its own."""
    mix = in_training_order(curriculum_mix(docs))
    return mix.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "position", "positions")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: The stages learn models and follow links to a fixed point; SQL has no equal. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
