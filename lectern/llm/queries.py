"""Queries that apply this subpackage's operators, with their production parameters, to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, license_scan, line_dedup, lloyd, minhash, pii, prefix_trie, quality_knn, quality_rules, secret_scan, suffix_dedup, token_counts
from .oracles import ORACLES
from .storage import new_path

#: File of the tokenizer that the token queries use.
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(_table(spark, sf_dir, "documents"), with_bytes=False)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call starts an empty cache, so that all texts are misses once."""
    return token_counts.count(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), new_path(spark, "token-cache"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_knn.classify(docs, quality_knn.fit(docs, _table(spark, sf_dir, "labels")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"]
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select(*names)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"), pii.learn())


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(_table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


_ALL = (op1_license_scan, op2_suffix_dedup, op3_minhash, op4_decontaminate, op5_token_counts, op6_bpe, op7_secret_scan, op8_quality_knn, op9_quality_rules, op10_pii, op11_lloyd, op12_line_dedup, op13_prefix_trie)
QUERIES = {f.__name__: f for f in _ALL}

__all__ = ["ORACLES", "QUERIES"]
