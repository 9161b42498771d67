"""Corpus preparation: language, lines, near copies, leaks, mixture.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept. ``docs`` has the columns of ``documents``; all stages but the last return
these. No column is trusted but doc_id: ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontam, durable, langid, linededup, mixing, shingles


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones."""
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, model).where(langid.accepted()).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur, alike or nearly, in an earlier one."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies (0.8 of five-word shingles shared); documents without an id stay."""
    return shingles.first_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares, with topic, tokens, probability and weight."""
    return mixing.mix(docs).where("sampled").drop("sampled")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]
#: A trained classifier and components of links have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = durable.keep(docs)
    return docs
