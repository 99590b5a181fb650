"""The corpus pipeline: quality rules, near-dedup, repeat removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
and reads again as the next stage's docs. All but the last return the columns of documents.

Decisions are on rows, not on ids: rows with null or repeated ids are judged by their own texts.
Null texts count as empty ones; empty tables give empty results; further columns pass through
the first four stages, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.decontaminate import benchmark_matches
from loomgraph.llm.pieces import digest, encode_nbest
from loomgraph.llm.quality_rules import apply_quality_rules
from loomgraph.llm.queries import vocabulary_path
from loomgraph.llm.repeats import Repeats, cut_text, without_repeats
from loomgraph.llm.simhash import simhash_groups
from loomgraph.llm.store import numbered, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of a repeat: a little under what 51 words take in the four languages of the tables, as
#: the stage is after passages of over 50 words.
PASSAGE = Repeats(length=240)

#: Fingerprints a text: one misses most near copies with a similarity of 0.8 to 0.95.
FINGERPRINTS = 4

#: Words of a shingle: an edit changes fewer of the short ones, so more near copies stay within 2 bits.
SHINGLE = 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base tests and the learned decision list keep. Null and empty texts fail
    the base test; equal texts have the same verdict."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("_doc"))
    judged, _ = apply_quality_rules(whole, table(spark, sf_dir, "labels"), carried=("_doc",))
    return judged.filter("kept").select("_doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that ``FINGERPRINTS`` independent fingerprints link: that
    with the smallest id, of these the one with the least text hash, of equal rows any one; rows
    without an id give way to rows with one. Texts without a word are one group."""
    rows, n = numbered(docs, "numbered")
    found = simhash_groups(rows, id_col=n, shingle=SHINGLE, count=FINGERPRINTS).select(F.col("doc_id").alias(n), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", F.xxhash64("text").alias("h"), F.col(n).alias("n"))
    stays = found.join(rows.select(n, order.alias("_o")), n).groupBy("_group").agg(F.min("_o").alias("_o")).select(F.col("_o.n").alias(n))
    return rows.join(stays, n, "left_semi").select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of ``PASSAGE.length`` that they repeat, in whole characters;
    texts of which nothing but white space is left go. Texts without repeats stay as they are."""
    found = without_repeats(docs, PASSAGE)
    touched = F.size("_rep_spans") > 0
    left = found.withColumn("text", cut_text(F.col("text"), F.col("_rep_spans"))).filter(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of a benchmark item."""
    rows, n = numbered(docs, "numbered")
    # Written, so that their size is known before the join: while they are few, the texts are not shuffled.
    leaks = written(benchmark_matches(rows, table(spark, sf_dir, "benchmark"), id_col=n).select(F.col("doc_id").alias(n)).distinct(), "leaks")
    return rows.join(leaks, n, "left_anti").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts, scores and checksums of each text's best segmentations."""
    return digest(encode_nbest(docs.select("doc_id", "text"), vocabulary_path(1)), "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: Learned rules, components, suffix arrays and lattices are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
