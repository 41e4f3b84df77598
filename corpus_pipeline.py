"""Corpus pipeline: quality classifier, quality rules, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next stage's ``docs``. All
but the last return the columns of ``documents``. SQL cannot express the learnt classifier or the tokenizer, so there is no SQL; the tests
compare each stage with brute force on its own input.

Defined cases: an empty table passes through every stage as an empty table; a null or empty text fails the rules (too few words) and goes there; rows without an
id, and rows that share one, are documents of their own; repeated rows are near duplicates, of which one stays; extra columns of ``documents`` are carried
along to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterflux.llm import mixing, oddsketch, packing, quality_classifier, quality_rules
from rasterflux.llm.common import discard, materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return quality_classifier.filter_documents(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy over the rule ledger rejects go."""
    return quality_rules.filter_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return oddsketch.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source has its target of words."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, placed in sequences."""
    return packing.op9(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("near duplicates", deduplicate),
    ("source mix", mix),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        older, docs = docs, materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(older)
    return last(spark, docs, sf_dir)
