"""The operators' queries over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentsec.llm import byte_bpe, chunk_dedup, html_extract, language_id, license_scan, mixing, parsing, quality, simhash, sql, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compared(table(spark, sf_dir, "documents"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


def removal_digests(docs: DataFrame, group: int = suffix_dedup.GROUP, bits: int = suffix_dedup.BITS) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return suffix_dedup.dedup(docs, group=group, bits=bits).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_neighbour_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    coded = byte_bpe.round_trip(docs, path, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_consistent_parsing": op1_consistent_parsing,
    "op2_language_mixture": op2_language_mixture,
    "op3_chunk_recipes": op3_chunk_recipes,
    "op4_pigeonhole_simhash": op4_pigeonhole_simhash,
    "op5_suffix_sort": op5_suffix_sort,
    "op6_neighbour_voting": op6_neighbour_voting,
    "op7_tag_path_ratios": op7_tag_path_ratios,
    "op8_water_filling": op8_water_filling,
    "op9_diagonal_voting": op9_diagonal_voting,
    "op10_merge_replay": op10_merge_replay,
}

#: The others have no SQL: they learn, hash by XXH64, compare bytes, read markup or replay merges; tests/llm has their
#: brute-force versions, round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op3_chunk_recipes": sql.OP3, "op8_water_filling": sql.OP8, "op9_diagonal_voting": sql.OP9}
