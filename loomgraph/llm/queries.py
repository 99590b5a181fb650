"""Thin ``opN_<name>`` queries: each applies one operator to a whole table and derives the
columns that its result is stated in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .centroids import centroid_clusters, cluster_report
from .decontaminate import benchmark_matches
from .kernel_quality import quality_scores
from .licenses import license_report, license_scan
from .maxent_lm import lm_scores
from .merkle import FIELDS, folded, leaf_hash, merkle_manifest, proof_digest
from .pieces import digest, encode_nbest
from .quality_rules import apply_quality_rules
from .repeats import cut_text, without_repeats
from .shards import shard_documents
from .simhash import simhash_components
from .store import fresh_path, table
from .token_files import read_token_files, write_token_files
from .tool_calls import SCHEMAS, calls_of_turns, linked_calls

#: op number -> tokenizer or model file of the installed vocabulary package.
VOCABULARY = {1: "piece_bpe_32k.model", 2: "byte_bpe_50k.json"}


def vocabulary_path(n: int) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY[n]))


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(encode_nbest(docs, vocabulary_path(1)), "doc_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary_path(2))
    return read_token_files(spark, path)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("_rep_spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        "doc_id",
        F.col("_rep_bytes").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("_rep_spans").cast("long").alias("n_spans"),
        F.sha2("_rep_kept", 256).alias("kept_sha256"),
        cut_text(F.coalesce("text", F.lit("")), F.col("_rep_spans")).alias("kept_text"),
    )


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op9_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of_turns(table(spark, sf_dir, "conversations"))
    return linked_calls(calls, results, SCHEMAS)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = leaf_hash([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    shown = F.when((F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull(), altered)
    found = merkle_manifest(docs, carried={"doc_id": F.col("doc_id"), "shown": shown}).rows
    back = folded(F.col("path"), F.coalesce("shown", "leaf"))
    rows = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(centroid_clusters(table(spark, sf_dir, "embeddings")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(license_scan(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece_nbest, op2_token_files, op3_quality_rules, op4_benchmark_decontamination, op5_simhash_near_dedup, op6_suffix_array_dedup, op7_balanced_shards, op8_maxent_lm, op9_kernel_quality, op10_tool_call_linking, op11_merkle_manifest, op12_centroid_clusters, op13_license_scan)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
