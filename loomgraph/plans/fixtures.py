"""Inputs that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.entities import entity_tables, extract_entities
from ..operators.folders import manifest_table
from ..operators.graph import backlink_edges, wikilink_edges
from ..operators.text import chunk_sections, unique_sections
from ..operators.vectors import hash_vector
from ..sources.corpus import file_rows, notes_from_documents

OVERVIEW_QUESTIONS = ((-1, "Give me an overview of the main topics"), (-2, "What is this vault about?"))


class Tables:
    """Lazy tables of one test folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def notes(self) -> DataFrame:
        return notes_from_documents(self["documents"])

    def notes2(self) -> DataFrame:
        """A second version of the notes: some edited, cut, stripped of headings, removed, copied."""
        rows = self.notes()
        tail = F.regexp_replace("content", r"\n[^\n]*\z", "")
        bare = F.regexp_replace("content", r"(?m)^#{1,6} .+\n", "")
        kind = F.col("doc_id") % 10
        text = F.when(kind == 1, F.concat("content", F.lit("\n\n\nEdited."))).when(kind == 3, tail).when(kind == 4, bare).otherwise(F.col("content"))
        kept = rows.filter(kind != 2).withColumn("content", text)
        copies = rows.filter("doc_id < 10").select((F.col("doc_id") + 900000).alias("doc_id"), F.concat(F.lit("copy/note-"), (F.col("doc_id") + 900000).cast("string"), F.lit(".md")).alias("path"), "content")
        return kept.unionByName(copies)

    def files(self) -> DataFrame:
        return file_rows(self.notes())

    def sections(self) -> DataFrame:
        return unique_sections(chunk_sections(self.notes()))

    def vectors(self) -> DataFrame:
        """Sections with vectors."""
        return self.sections().withColumn("embedding", hash_vector(F.col("text")))

    def entities(self) -> tuple[DataFrame, DataFrame]:
        return entity_tables(extract_entities(self.sections()))

    def links(self) -> DataFrame:
        return wikilink_edges(self.sections(), self.files())

    def edges(self) -> DataFrame:
        links = self.links()
        return links.unionByName(backlink_edges(links))

    def questions(self) -> DataFrame:
        first = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
        rows = self["benchmark"].select(F.col("item_id").alias("q_id"), first.alias("question"))
        return rows.unionByName(self.spark.createDataFrame(OVERVIEW_QUESTIONS, "q_id long, question string"))

    def manifest(self) -> DataFrame:
        """The manifest of the notes' folders, as parsed from its text."""
        langs = self["documents"].select("lang").distinct()
        heads = langs.select(F.lit("m").alias("manifest_id"), F.concat(F.lit("## "), "lang", F.lit("/ <!-- "), "lang", F.lit(" collection -->")).alias("line"), F.concat("lang", F.lit("0")).alias("k"))
        subs = langs.select("lang", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("s")).select(F.lit("m").alias("manifest_id"), F.concat(F.lit("### src"), "s", F.lit("/ <!-- notes of src"), "s", F.lit(" -->")).alias("line"), F.concat("lang", F.lit("1"), "s").alias("k"))
        rows = heads.unionByName(subs).groupBy("manifest_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
        return manifest_table(rows.select("manifest_id", F.concat(F.lit("# vault\n"), "body").alias("content")))

    def ledger_events(self) -> DataFrame:
        amount = F.when(F.col("event_type") == "purchase", 0.2).when(F.col("event_type") == "click", 0.1).when(F.col("event_type") == "error", -0.1).when(F.col("event_type") == "signup", -0.3).otherwise(0.0)
        none = F.lit(None).cast("string")
        other = F.array(F.concat(F.lit("h"), ((F.col("user_id") * 7 + 1) % 50).cast("string")))
        seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
        return self["events"].select(F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("run_id"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("id"), seq.alias("seq"), F.lit("score").alias("op"), amount.alias("amount"), none.alias("assumption"), none.alias("evidence"), F.when(F.col("event_type") == "error", other).alias("contradicts"), "ts")

    def runs(self) -> DataFrame:
        """One run a fifth of the users; coverage and counters from their events."""
        rows = self["events"].groupBy(F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("run_id"))
        return rows.agg((F.count(F.when(F.col("value") > 50, 1)) / F.count(F.lit(1))).alias("coverage"), (F.count(F.lit(1)) % 3).cast("int").alias("verify_rounds"), (F.max("value") > 0).alias("index_available"), (F.count(F.lit(1)) % 60).cast("int").alias("calls_used"), F.lit(60).alias("call_budget"))

    def inbox(self) -> str:
        return "en/src8"
