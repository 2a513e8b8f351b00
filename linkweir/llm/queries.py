"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontamination, filter_audit, importance_resampling, jaccard_join, lm_scoring, packing, quality_classifier, quality_rules, token_counts, token_file, toxicity, warc
from .common import read_table, small_batches


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_file.encode_and_read(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_rules(read_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return warc.archive_and_read(read_table(spark, sf_dir, "pages"), min_bytes=0)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lm_scoring.score_texts(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return importance_resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark, 1000)
    return byte_bpe.encode_and_decode(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


_ALL = (
    op1_decontamination, op2_toxicity, op3_token_file, op4_quality_rules, op5_warc, op6_jaccard_join, op7_token_counts, op8_packing,
    op9_quality_classifier, op10_lm_scoring, op11_filter_audit, op12_importance_resampling, op13_byte_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality_rules.sql(),
        "op5_warc": warc.sql(),
        "op6_jaccard_join": jaccard_join.sql(3, 90, 100),
        "op11_filter_audit": filter_audit.sql(),
        "op12_importance_resampling": importance_resampling.sql(),
    }
