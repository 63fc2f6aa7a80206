"""The opN_ queries over the driver's tables, with production parameters, and
their SQL where SQL can express them."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_matrix, count_transducer, ecoc_langid, importance, minhash, oracle, positional_index, ppm_score, rp_forest, suffix_dedup, token_store
from .common import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score.scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_vectors(table(spark, sf_dir, "embeddings"), limit=0.93)


def op4_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10).drop("k2")


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return importance.resample(table(spark, sf_dir, "documents"), target, share=0.8)


def op6_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecoc_langid.identify(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_matrix.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN, ids=False)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op10_count_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def _tidy(name: str, query):
    """The query, its rows written once and its intermediate tables deleted."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return settled(spark, lambda: query(spark, sf_dir), name)

    return run


_QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_ppm_score": op2_ppm_score,
    "op3_rp_forest": op3_rp_forest,
    "op4_positional_index": op4_positional_index,
    "op5_importance": op5_importance,
    "op6_ecoc_langid": op6_ecoc_langid,
    "op7_minhash": op7_minhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_count_transducer": op10_count_transducer,
}
QUERIES = {name: _tidy(name, query) for name, query in _QUERIES.items()}

#: The others hold models or tokenizers, which SQL can't express; their tests
#: compare them with brute-force versions and the tokenizers' libraries.
ORACLE = {
    "op3_rp_forest": oracle.OP3,
    "op4_positional_index": oracle.OP4,
    "op7_minhash": oracle.OP7,
    "op9_suffix_dedup": oracle.OP9,
}
