"""A training corpus from documents: language ID, quality, near copies, mixing, tokens.

Each stage reads what its predecessor kept, as Parquet in the shared folder, and all but the last return the columns of
documents. SQL can't express the learned stages, so there is none for run(); the tests check it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import bpe, language_id, mixing, ngram_join, quality
from tideline.llm._common import Scratch, ship
from tideline.llm.queries import table, vocabulary


BATCH = 1000  # rows of a batch between Spark and Python: texts are long, and a task holds a batch on both sides


def ready(spark: SparkSession) -> None:
    """Sends the code to the workers and bounds their batches, unless the session has a smaller bound."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    ready(spark)
    return language_id.keep_known(spark, docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of rejected quality go."""
    ready(spark)
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    ready(spark)
    return ngram_join.one_of_each(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ready(spark)
    return mixing.mixed_documents(spark, docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of ids and decoded text of every row."""
    ready(spark)
    return bpe.digests(docs, vocabulary())


STAGES = [("language_id", language_stage), ("quality", quality_stage), ("near_copies", near_copy_stage), ("mixing", mixing_stage), ("tokens", token_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
