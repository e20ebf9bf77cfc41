"""The corpus pipeline: quality, exact and near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor left them,
and all but the last return the columns of documents. Every stage works on
all rows; null and empty texts, null ids, repeated rows, other columns and empty
tables are treated as the docstrings of the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm.byte_bpe import round_trips
from kinmatch.llm.common import documents, stored
from kinmatch.llm.decontamination import keep_clean
from kinmatch.llm.exact_dedup import keep_first
from kinmatch.llm.jaccard_join import keep_one_of_each
from kinmatch.llm.quality import keep_good


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line field rejects (op7)."""
    return keep_good(docs, documents(spark, sf_dir, "labels"))


def first_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, keep the one with the smallest id (op10)."""
    return keep_first(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in five-word shingles, keep the one with the smallest id (op5)."""
    return keep_one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark passages make up a twentieth of the words or more (op3)."""
    return keep_clean(docs, documents(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to (op9)."""
    return round_trips(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", good_quality), ("exact_dedup", first_of_equals), ("jaccard_join", one_of_similar), ("decontamination", no_benchmark), ("byte_bpe", tokens)]

#: The first stage is a fitted model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
