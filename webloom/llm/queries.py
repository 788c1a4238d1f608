"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import kdshards, licenses, media, mixing, quality, resample, simhash, tokenbin, tokencounts, topk, urls, whitening, winnow
from webloom.session import table

#: Mixture of the op8 query: shares of the corpus's words.
WEIGHTS = {"good": 0.90, "poor": 0.06, "toxic": 0.04}


def tokenizer_path() -> str:
    """The public byte-level BPE; pass another path to the operator for another vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        scores = tokencounts.ranked_scores(f.read().splitlines())
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), scores)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshards.shard(table(spark, sf_dir, "documents"), 40)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.encode_column(table(spark, sf_dir, "documents")))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.domain_of_labels(table(spark, sf_dir, "labels"))
    return mixing.mixture(table(spark, sf_dir, "documents"), labelled, WEIGHTS)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filters": op2_url_filters,
    "op3_kd_shards": op3_kd_shards,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_media_columns": op6_media_columns,
    "op7_token_output": op7_token_output,
    "op8_source_mixing": op8_source_mixing,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_exact_topk": op12_exact_topk,
    "op13_importance_resampling": op13_importance_resampling,
    "pipeline": pipeline,
}

#: Those that SQL can express; the rest is held against brute force, round trips or held-out labels in tests/llm.
ORACLES: dict[str, str] = {
    "op2_url_filters": urls.oracle_sql(),
    "op5_benchmark_decontamination": winnow.oracle_sql(),
    "op10_license_scan": licenses.oracle_sql(),
    "op12_exact_topk": topk.oracle_sql(),
    "op13_importance_resampling": resample.oracle_sql(),
}
