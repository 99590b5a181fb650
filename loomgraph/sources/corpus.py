"""Scans, tables and sinks of the corpus index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import folder_of, title_of

# The tables of the index: every schema is explicit, none is inferred.
SCHEMAS = {
    "files": "file_id string, path string, title string, folder string, owner string, created_date timestamp, modified_date timestamp, reviewed_date timestamp, version int, content_type string, granularity string, content_hash string, rollup_summary string",
    "sections": "node_key string, file_id string, heading_path string, heading_text string, line_start int, line_end int, text string, content_hash string, embedding array<double>",
    "entities": "entity_id string, name string, type string",
    "section_entities": "section_key string, entity_id string",
    "edges": "src_key string, dst_key string, kind string, weight double",
    "communities": "community_id string, seed_source string, label string",
    "community_sections": "section_key string, community_id string",
    "community_reports": "community_id string, report string, model string, tokens int, built_at timestamp",
    "index_meta": "snapshot_id string, built_at timestamp, vault_version string, manifest_hash string",
}
JOURNAL = "unit_id string, idempotency_key string, source_handle string, state string, destination_handle string, heading string, receipt_id string, reason string"
CACHE = "content_hash string, model string, dims int, embedding array<double>"


def scan_corpus(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """All ``*.md`` files under ``root``; hidden folders and ignored paths are skipped. Line ends
    are normalised to LF. Files without a byte are not seen, as Spark's file scan leaves them out:
    the ``notes`` format of ``notes_format`` has them, on mounted folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    # Spark counts a file as four megabytes at least, so a task would read some 32 small ones.
    parts = raw.rdd.getNumPartitions()
    raw = raw.coalesce(max(1, 16 * spark.sparkContext.defaultParallelism, parts // 32))
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    files = raw.select(
        rel.alias("path"),
        F.col("modificationTime").alias("modified_date"),
        F.sha1("content").alias("content_hash"),
        F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n", "\n").alias("content"),
    )
    files = files.filter(~F.col("path").rlike(r"(^|/)\.[^/]+/")).withColumn("title", title_of(F.col("path")))
    return ignore_filter(files, ignore, "path") if ignore else files


def glob_regex(pattern: str) -> str:
    """A glob as a whole-string pattern: ``*`` any text, ``?`` one character."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def ignored(path: Column, patterns: list[str], include_children: bool = True) -> Column:
    """Whether a path, or its last part, matches a pattern; with children also what lies under
    a matching folder. A leading ``!`` never brings a path back."""
    kept = [p.strip() for p in patterns if p.strip() and not p.strip().startswith("#")]
    globs = [glob_regex(p) for p in kept if not p.startswith("!")]
    hit = F.lit(False)
    if globs:
        whole = "(?s)\\A(?:" + "|".join(globs) + ")\\z"
        hit = path.rlike(whole) | F.element_at(F.split(path, "/"), -1).rlike(whole)
    if include_children:
        dirs = [re.escape(p.rstrip("/")) for p in kept if p.rstrip("/")]
        if dirs:
            hit = hit | path.rlike("\\A(?:" + "|".join(dirs) + ")(?:/|\\z)")
    return hit


def ignore_filter(df: DataFrame, patterns: list[str], path_col: str = "path", include_children: bool = True) -> DataFrame:
    return df.filter(~ignored(F.col(path_col), patterns, include_children))


def corpus_from_table(df: DataFrame, id_col: str, text_col: str, folder: Column | None = None) -> DataFrame:
    """Any (id, text) table as a corpus: path, title, folder, content, content_hash, version."""
    path = F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise("") if folder is not None else F.lit(""), F.col(id_col).cast("string"), F.lit(".md"))
    content = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(path.alias("path"), content.alias("content")).select(
        "path", title_of(F.col("path")).alias("title"), folder_of(F.col("path")).alias("folder"), "content", F.sha1("content").alias("content_hash"), F.lit(1).alias("version")
    )


def notes_from_documents(docs: DataFrame) -> DataFrame:
    """The notes corpus that tests and queries use: documents as markdown notes with headings,
    links, tags and frontmatter by a fixed rule on the line number."""
    total = docs.count()
    pad = lambda c: F.lpad(c.cast("string"), 6, "0")
    folder = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.concat("lang", F.lit("/"), "source", F.lit("/")))
    name = F.when(F.col("doc_id") % 37 == 0, "moc-").otherwise("note-")

    def line(x: Column, i: Column) -> Column:
        head = F.when(i % 12 == 0, "# ").when(i % 4 == 0, "## ")
        t = (F.col("doc_id") * 7 + i) % total
        link = F.concat(F.lit(" [[note-"), pad(t), F.when(t % 50 == 0, ".md").otherwise(""), F.when(i % 9 == 4, "#Part").otherwise(""), F.lit("]]"))
        return F.concat(
            F.when(head.isNotNull(), F.concat(head, F.substring(x, 1, 24), F.lit("\n"))).otherwise(""),
            x,
            F.when(i % 3 == 1, link).otherwise(""),
            F.when(i % 5 == 2, F.concat(F.lit(" #"), "lang")).otherwise(""),
        )

    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    front = F.concat(F.lit("---\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\n---\n"))
    return docs.select("doc_id", F.concat(folder, name, pad(F.col("doc_id")), F.lit(".md")).alias("path"), F.concat(front, body).alias("content"))


def file_rows(notes: DataFrame) -> DataFrame:
    """FILES columns of a notes corpus."""
    path = F.col("path")
    return notes.select(path.alias("file_id"), "path", title_of(path).alias("title"), folder_of(path).alias("folder"), F.sha1("content").alias("content_hash"))


def file_stats(notes: DataFrame) -> DataFrame:
    """Size, short hash and line count per file."""
    return notes.select("path", F.octet_length("content").alias("size"), F.substring(F.sha1("content"), 1, 12).alias("hash"), F.size(F.split("content", "\n")).alias("n_lines"))


def read_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def write_index(df: DataFrame, path: str, name: str) -> None:
    """One table of a snapshot, with exactly the columns of its schema; missing ones are null."""
    want = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]).write.mode("overwrite").parquet(f"{path}/{name}")


def reset_index(spark: SparkSession, path: str) -> None:
    """Every table of the snapshot directory emptied."""
    for name, schema in SCHEMAS.items():
        write_index(spark.createDataFrame([], schema), path, name)


def merge_replace(old: DataFrame, new: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Last writer wins by ``order_col``; rows of ``new`` win over equal ones of ``old``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = W.partitionBy(*keys).orderBy(F.col(order_col).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def merge_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """First writer wins: rows of ``new`` with a known key are dropped."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def append_meta(spark: SparkSession, path: str, version: str, manifest_hash: str = "") -> None:
    row = spark.range(1).select(F.uuid().alias("snapshot_id"), F.current_timestamp().alias("built_at"), F.lit(version).alias("vault_version"), F.lit(manifest_hash).alias("manifest_hash"))
    row.write.mode("append").parquet(f"{path}/index_meta")


def latest_meta(spark: SparkSession, path: str) -> DataFrame:
    return read_index(spark, path, "index_meta").orderBy(F.col("built_at").desc()).limit(1)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL).json(path)


def append_journal(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def pending_units(journal: DataFrame) -> DataFrame:
    return journal.filter("state = 'pending'")


def load_cache(spark: SparkSession, path: str, model: str, dims: int) -> DataFrame:
    """Cached vectors of one (model, dimensions) stamp; other stamps are as if absent."""
    return spark.read.schema(CACHE).parquet(path).filter((F.col("model") == model) & (F.col("dims") == dims)).select("content_hash", "embedding")


def append_cache(vectors: DataFrame, path: str, model: str, dims: int) -> None:
    kept = vectors.filter(F.size("embedding") > 0).dropDuplicates(["content_hash"])
    kept.select("content_hash", F.lit(model).alias("model"), F.lit(dims).alias("dims"), F.col("embedding").cast("array<double>").alias("embedding")).write.mode("append").parquet(path)


def render_sink(df: DataFrame, key_col: str, text_col: str, path: str) -> None:
    """One text per key, in a folder of its key."""
    df.select(F.col(key_col), F.col(text_col).alias("value")).write.mode("overwrite").partitionBy(key_col).text(path)
