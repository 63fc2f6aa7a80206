"""Corpus pipeline: language ID, near-duplicates, repeated passages, benchmark
passages, token ids. Each stage works on all that the one before kept; the
first four return the columns of documents, the last the token ids.

- language_id: documents that are `und` (no letter) or ambiguous go;
- near_duplicates: one document of each group stays, that of smallest doc_id;
- repeated_bytes: bytes of 50-byte strings that a document of smaller doc_id
  also holds are taken out of the text; the document stays;
- decontaminate: documents that hold ten consecutive words of a benchmark item
  (or the whole of a shorter one) go;
- byte_bpe: doc_id, n_tokens, digests and ids of every text that is left.

Defined results: null and empty texts, and texts without a letter, are `und` and
go in the first stage; a null lang isn't learnt from. Rows without a doc_id are
judged by language and benchmark like any other, have no group and neither lose
bytes nor take them from others. Rows of one doc_id: near_duplicates keeps or
drops the id with all its texts, equal ones as one row; they take no bytes from
each other; the other stages look at each row. Texts of any length count whole.
Extra columns, clashing names included, come through the first four stages as
they are (n_chars is counted anew where text changes). An empty table gives an
empty table. Where no document has a lang, none is learnt and all are `und`; an
empty benchmark takes nothing out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe_matrix, ecoc_langid, minhash, positional_index, suffix_dedup
from panelforge.llm.common import new_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ecoc_langid.identified(docs, ecoc_langid.fit(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs, 50)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return positional_index.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_matrix.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: Models and token ids can't be written in SQL; tests/llm/test_pipeline.py
#: holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
