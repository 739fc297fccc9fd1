"""A corpus pipeline of five of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next stage. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, jaccard_join, language_id, mixing, queries, token_output
from sparkloom.llm.common import prepare, shared_path


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with hardly any share of one, go."""
    prepare(spark)
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    prepare(spark)
    return jaccard_join.keep_one_per_component(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go."""
    prepare(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_contaminated(docs, items, window=13, share=20)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    prepare(spark)
    return mixing.mix(docs, seed=0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of all that is left, as read back."""
    prepare(spark)
    return token_output.report(docs, queries.tokenizer_path(), end_id=2)


STAGES = [
    ("language_id", language_identification),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_ids),
]

#: SQL cannot express the models, tries and files of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; the last one's result."""
    path = f"{sf_dir}/documents.parquet"
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, spark.read.parquet(path), sf_dir)
        if k == len(STAGES) - 1:
            return result
        path = shared_path(spark, f"pipeline-{name}")
        result.write.parquet(path)
    raise ValueError("STAGES is empty")
