"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its result is written as Parquet and
read again. A stage is judged on its own input. Stages one, two and four drop rows, the third cuts texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anisoframe.llm import bpe, decontaminate, quality, shingle_join, suffix_dedup
from anisoframe.llm.files import new_folder
from anisoframe.llm.queries import tokenizer_path

#: SQL can't express the fingerprints, the forest and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 80 % or more of their five-word shingles."""
    return shingle_join.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without strings of 200 bytes that occur elsewhere as well."""
    return suffix_dedup.remove_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return bpe.measure(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("repeated strings", repeated_strings),
    ("benchmark passages", benchmark_passages),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
