"""Corpus pipeline: language, repeated lines, near copies, benchmark leaks, then tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread
as the next stage's docs.  All but the last return the columns of ``documents``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import bpe, decontaminate, language_id, line_dedup, simhash
from riskframe.session import scratch_path
from riskframe.sources.tables import table_path


def recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``und`` and scores under 0.4 go."""
    return language_id.accepted(docs, language_id.fit(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line within one edit.

    A document that loses all its words this way goes.
    """
    done = line_dedup.dedup_lines(docs)
    return done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each SimHash group (3-word shingles, 2 bits)."""
    return simhash.one_of_each_group(docs, shingle=3, max_bits=2)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.without_leaks(docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, packed ids and decoded text."""
    import public_tokenizers
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", recognised_language), ("lines", without_repeated_lines), ("near_duplicates", one_of_each_group),
          ("benchmark", without_benchmark), ("tokens", tokens)]

#: Edit neighbourhoods, SimHash components and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
