"""The registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    adaptive_rules,
    bpe_replay,
    collocations,
    host_reputation,
    html_template,
    interval_overlap,
    langid_backoff,
    line_dedup,
    merkle,
    ngram_jaccard,
    packing,
    pairwise_quality,
    secrets_index,
)
from .common import crc_mod, table
from .oracle import ORACLE_SQL  # noqa: F401

BYTE_BPE, WORD_BPE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"
#: The id that ends a document in a sequence.
END_ID = 2


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod(F.col("doc_id"), 5)
    out = pairwise_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold != 0)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), END_ID)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_index.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda x: x["kind"] < len(secrets_index.BASE))

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets_index.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets_index.written(base), 256).alias("base_sha256"), secrets_index.written(F.col("found")).alias("spans"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3)
    out = langid_backoff.predict(docs, langid_backoff.fit(docs.where(fold != 1)))
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op8_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_pages(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_dropped").cast("long").alias("n_dropped"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_overlap.overlaps(*(table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clicks")))


def op13_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return host_reputation.judge(pages, host_reputation.page_outcomes(pages, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_pairwise_quality": op2_pairwise_quality,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_langid": op6_langid,
    "op7_merkle": op7_merkle,
    "op8_adaptive_rules": op8_adaptive_rules,
    "op9_html_template": op9_html_template,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_interval_overlap": op12_interval_overlap,
    "op13_host_reputation": op13_host_reputation,
}
