"""A training corpus from raw documents: rules, toxicity, near copies, benchmark text, token ids."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from railweave.checkpoints import written
from railweave.shipping import shipped
from railweave.llm import bpe, decontaminate, quality, simhash, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stand mostly in content lines."""
    return quality.without_boilerplate(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id."""
    return simhash.keep_one_per_group(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contaminated ones: where benchmark spans cover the limit, the whole row goes."""
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop_coverage=0.0)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [(name, shipped(stage)) for name, stage in [("quality rules", quality_stage), ("toxicity", toxicity_stage), ("near copies", near_copies_stage), ("benchmark decontamination", benchmark_stage), ("byte-level BPE", tokens_stage)]]

#: SQL can express neither the trained stages nor the fingerprints; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each but the last is written in the checkpoint folder, so no stage runs twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
