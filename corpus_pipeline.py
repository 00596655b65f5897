"""Stages that turn `documents` into token counts and digests of the documents worth training on.

Each stage gets its predecessor's rows with all columns of `documents` and returns the rows that it keeps, with the same
columns; the last one returns one row of token digests per row. Null and empty texts pass every filter but exact
duplicates of each other. An empty table goes through all stages as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from footgrid.llm import decontaminate, exact, near, queries, toxicity
from footgrid.session import _shared_folder

#: No SQL dialect at hand expresses the classifier or the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not reject."""
    return toxicity.clean(docs, queries.table(spark, sf_dir, "labels"))


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return near.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every text that is left."""
    return queries.token_digests(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", duplicates), ("ngram_join", near_copies), ("decontaminate", leaks), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written in the shared folder and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{_shared_folder(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
