"""A training corpus from documents: reject, drop copies, drop near copies, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentsec.llm import byte_bpe, chunk_dedup, mixing, quality, simhash
from contentsec.llm.common import materialize, remove_tables, scratch


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (6): documents that it rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (3): of equal texts, the largest doc_id stays."""
    return chunk_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (4): of each group, the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (8): a row for each repetition that the mix takes, a part of a repetition as the text's first words."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (10): token ids of each row, and digests of them and of the bytes that they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.round_trip(docs, path, pattern)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", accept), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("source_mixing", mix), ("byte_bpe", tokenize)]

#: The classifier, SimHash and BPE have no SQL; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and the one that it read, are removed when its result is written."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch(spark, done):
            docs = materialize(stage(spark, docs, sf_dir), name)
        remove_tables(spark, done[:-1])
        del done[:-1]
    return docs
