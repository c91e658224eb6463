"""A corpus from raw documents to token files: quality, near copies, benchmark passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of docs. Near copies are those of five-word shingles with a similarity of 0.8 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import decontamination, mixing, near_dedup, quality_model, token_output
from touchline.llm.common import table
from touchline.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least id."""
    return near_dedup.first_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, up to twice or not at all."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: a row for each document in them."""
    return token_output.token_table(docs)


STAGES = [("quality", quality), ("near copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

#: Fitted scores, hash functions and a tokenizer: SQL cannot express them. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
