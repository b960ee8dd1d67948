"""The corpus pipeline: quality, line deduplication, one document of each near-duplicate group, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import line_dedup, ngram_jaccard, packing, pairwise_quality, secrets_index
from spindrift.llm.common import cut, table

WORD_BPE, END_ID = "word_bpe_49k.json", 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, doesn't reject."""
    return pairwise_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document all of whose lines repeat goes."""
    return line_dedup.keep_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return ngram_jaccard.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by its kind."""
    return secrets_index.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), END_ID)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("secrets", secrets), ("packing", pack)]

#: The classifier's weights, MinHash and tokenizer ids are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
