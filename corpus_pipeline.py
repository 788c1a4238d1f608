"""From raw documents to token shards: every stage works on all that the one before it kept.

All stages take nulls in any column, empty and long texts, repeated rows and extra columns of any name. An empty
``documents`` passes through every stage and gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import mixing, quality, simhash, tokenbin, winnow
from webloom.llm.common import materialize
from webloom.llm.queries import tokenizer_path
from webloom.session import clear_written, table, written_so_far

#: Word shares that the mixture aims at, and its size against the stage's input. The budget lies over 1 so that good documents keep a rate of one or more.
WEIGHTS, BUDGET, FLOOR = {"good": 0.94, "poor": 0.03, "toxic": 0.03}, 1.1, 0.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score under one half). Null and empty texts are scored like any; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every near-duplicate group (Jaccard 0.8 of five-word shingles): the least doc_id, null last; all texts without words are one group."""
    return simhash.dedup(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark window. Null and empty texts hold none; without a benchmark all stay."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents by their fitted rates: whole rows, copies with equal ids. Without labels there is one domain with rate BUDGET."""
    return mixing.resample(docs, mixing.domain_of_labels(table(spark, sf_dir, "labels")), WEIGHTS, BUDGET, FLOOR)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns their digest read back; null and empty texts are the end id alone."""
    return tokenbin.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: No SQL: the network, the fingerprints and the tokenizer are not SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again as the next one's input. What a stage wrote for itself, and its input, goes once its result is written."""
    docs, mark = table(spark, sf_dir, "documents"), written_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear_written(spark, mark, written_so_far(spark) - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
