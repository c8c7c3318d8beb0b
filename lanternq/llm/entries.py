"""Queries of the training-data operators and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chunked_bpe, decontamination, exact_dedup, html_text, periodic_runs, pii, simhash, substring_dedup, suffix_arrays, token_files, toxicity, warc
from .sql import ORACLE_SQL  # noqa: F401


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """A public tokenizer file: of the installed package, or in a folder."""
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "item_tokens")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    return token_files.token_file_index(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json", tokenizers))


def op5_chunked_bpe(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    return chunked_bpe.tokenize(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json", tokenizers))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.drop_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_repeated_tail(table(spark, sf_dir, "documents"))
    return periodic_runs.summary(periodic_runs.periodic_runs(planted))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_benchmark_decontamination, op3_html_extraction, op4_token_files, op5_chunked_bpe,
        op6_substring_dedup, op7_simhash, op8_toxicity, op9_pii, op10_warc, op11_suffix_array_dedup, op12_periodic_runs, op13_centroid_clustering,
    )
}
