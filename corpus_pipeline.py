"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Toxic documents go, then those that the quality rules reject, then all but one of each group of near duplicates (five-word
shingles, Jaccard similarity 0.8 or more), then those that hold a benchmark item; the rest is packed into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkweir.llm import decontamination, jaccard_join, packing, quality_rules, toxicity
from linkweir.llm.common import materialize, read_table, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores below 0.7."""
    small_batches(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), "toxic", 3, 1)
    return toxicity.keep_clean(docs, model, 0.7)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule keeps. The row travels as one struct, so its columns clash with no measure."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return quality_rules.score_rules(rows, keep=("_row",)).where("kept").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of the least id, nulls first; of rows with the same id and text one stays.

    Rows are told apart by id and text, so that one id with unlike texts keeps each; blank texts are like none. The row
    travels as one struct, so its columns clash with none made here."""
    small_batches(spark)
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64("text").alias("text")).alias("doc_id"), "text")
    groups = jaccard_join.near_duplicates(rows, k=5, num=80, den=100)
    first = materialize(groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("rows")), "first-of-group")
    kept = rows.select("doc_id", "row").join(first, "doc_id")
    many = kept.where("rows > 1").withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("rows"))).where("place = 1")
    return kept.where("rows = 1").select("row.*").unionByName(many.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    small_batches(spark)
    return decontamination.remove_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document that is left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack_batches),
]

#: Fitted models and similarity joins have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
