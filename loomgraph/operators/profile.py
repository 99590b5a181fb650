"""Corpus profiles by stratified, deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import classify_note, first_words, strip_frontmatter, title_of, top_folder, trimmed, word_count
from .text import body_lines, inline_tags

OPTIONS = {"root_words": 200, "moc_words": 120, "regular_words": 40, "budget": 4000, "target": 20}


def note_facts(notes: DataFrame) -> DataFrame:
    """(path, title, kind, folder, tags, n_words, outline, body) of each note; narrow."""
    body, tags = strip_frontmatter(F.col("content")), inline_tags(F.col("content"))
    outline = F.transform(F.slice(F.filter(body_lines(F.col("content")), lambda x: x.rlike(r"\A#{1,6}\s+")), 1, 30), trimmed)
    rows = notes.select("path", title_of(F.col("path")).alias("title"), top_folder(F.col("path")).alias("folder"), tags.alias("tags"), word_count(body).alias("n_words"), outline.alias("outline"), body.alias("body"))
    return rows.withColumn("kind", classify_note(F.col("path"), F.col("title"), F.lit(None).cast("string"), F.col("tags")))


def allocate_sample(strata: DataFrame, target: int = 20) -> DataFrame:
    """(folder, size, quota): quotas in proportion to size by largest remainder, ties by name; a
    stratum gets one extra at most and never more than it has."""
    total = strata.agg(F.sum("size").alias("total"))
    rows = strata.join(F.broadcast(total)).withColumn("exact", F.col("size") / F.col("total") * target)
    rows = rows.withColumn("base", F.floor("exact")).withColumn("frac", F.col("exact") - F.col("base"))
    left = rows.agg((F.lit(target) - F.sum("base")).alias("left"))
    rows = rows.withColumn("room", F.col("base") + 1 <= F.col("size"))
    order = W.partitionBy("room").orderBy(F.round("frac", 12).desc(), "folder")  # one row a folder
    rows = rows.withColumn("rank", F.row_number().over(order)).join(F.broadcast(left))
    extra = F.when(F.col("room") & (F.col("rank") <= F.col("left")), 1).otherwise(0)
    return rows.select("folder", "size", F.least("size", F.col("base") + extra).cast("long").alias("quota"))


def stride_sample(files: DataFrame, quotas: DataFrame) -> DataFrame:
    """(folder, path): of each folder's sorted paths the rows round(k * n / quota)."""
    order = W.partitionBy("folder").orderBy("path")
    rows = files.select("folder", "path").withColumn("i", F.row_number().over(order) - 1)
    wanted = quotas.filter("quota > 0").select("folder", "size", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("k"))
    index = F.when(F.col("quota") >= F.col("size"), F.col("k")).otherwise(F.least(F.col("size") - 1, F.floor(F.col("k") * F.col("size") / F.col("quota") + 0.5)))
    return rows.join(wanted.select("folder", index.cast("int").alias("i")).distinct(), ["folder", "i"]).select("folder", "path")


def per_file_budget(n: Column, budget: int = 4000, cap: int = 40) -> Column:
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(cap), F.floor(F.lit(budget) / F.greatest(n, F.lit(1))).cast("int"))))


def folder_summary(facts: DataFrame, k: int = 3) -> DataFrame:
    """(folder, n_files, mean_words, tags): per top folder; ``tags`` are its k most frequent."""
    base = facts.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.floor(F.avg("n_words") + 0.5).cast("long").alias("mean_words"))
    counts = facts.select("folder", F.explode("tags").alias("tag")).groupBy("folder", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("folder").orderBy(F.col("n").desc(), "tag")
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    tags = top.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), ",").alias("tags"))
    return base.join(tags, "folder", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def sample_corpus(notes: DataFrame, options: dict | None = None, path_filter: str | None = None) -> DataFrame:
    """(path, kind, n_words, excerpt, excerpt_words): all root and moc notes, and the sampled
    regular ones, with excerpts of their kind's length."""
    o = OPTIONS | (options or {})
    facts = note_facts(notes)
    if path_filter:
        facts = facts.filter(F.lower("path").contains(path_filter.lower()))
    regular = facts.filter("kind = 'regular'")
    quotas = allocate_sample(regular.groupBy("folder").agg(F.count(F.lit(1)).alias("size")), o["target"])
    picked = stride_sample(regular.select("folder", "path"), quotas)
    budget = picked.agg(per_file_budget(F.count(F.lit(1)), o["budget"], o["regular_words"]).alias("per_file"))
    chosen = facts.filter("kind <> 'regular'").unionByName(regular.join(picked.select("path"), "path", "left_semi").select(*facts.columns))
    size = F.when(F.col("kind") == "root", o["root_words"]).when(F.col("kind") == "moc", o["moc_words"]).otherwise(F.col("per_file"))
    out = chosen.join(F.broadcast(budget)).withColumn("excerpt", first_words(F.col("body"), size))
    return out.select("path", "kind", "n_words", "excerpt", word_count(F.col("excerpt")).alias("excerpt_words"))


def coverage(sampled: DataFrame, folders: DataFrame) -> DataFrame:
    """(coverage): top folders with a sampled note, of all top folders."""
    mark = folders.select("folder").distinct().join(sampled.select("folder").distinct().withColumn("hit", F.lit(1)), "folder", "left")
    return mark.agg(F.coalesce(F.sum("hit") / F.count(F.lit(1)), F.lit(0.0)).alias("coverage"))


def profile_cache(notes: DataFrame, cached: DataFrame) -> DataFrame:
    """Facts of every note (path, modified_date, content): cached rows (with path and
    modified_date) are used where the time is the same; only the others are derived."""
    known = cached.join(notes.select("path", "modified_date"), ["path", "modified_date"], "left_semi").withColumn("hit", F.lit(True))
    fresh = notes.join(known.select("path"), "path", "left_anti")
    derived = note_facts(fresh).join(fresh.select("path", "modified_date"), "path").withColumn("hit", F.lit(False))
    return known.unionByName(derived.select(*known.columns))


def profile_report(profile: DataFrame, folders: DataFrame) -> DataFrame:
    """(seq, line): one text line a folder and a note, in order."""
    a = folders.select(F.lit(0).alias("part"), F.col("folder").alias("key"), F.format_string("%s/: %d notes, %d words on average, tags %s", "folder", "n_files", "mean_words", "tags").alias("line"))
    b = profile.select(F.lit(1).alias("part"), F.col("path").alias("key"), F.format_string("%s [%s, %d words]: %s", "path", "kind", "n_words", F.regexp_replace("excerpt", r"\s+", " ")).alias("line"))
    return a.unionByName(b).select("part", "key", "line")
