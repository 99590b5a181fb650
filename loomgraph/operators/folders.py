"""Folder tables, manifests and folder purposes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ancestors, file_of, trimmed

TOC = r"\A(#{1,6})\s+([^<]+?)\s*(?:<!--\s*(.*?)\s*-->)?\s*\z"
TOC_FILE = r"\A\s*[-*]\s+([^<]+?)\s*(?:<!--\s*(.*?)\s*-->)?\s*\z"
# Folder-name words by content type, tested in this order.
REFERENCE_WORDS = ("standard", "rule", "reference", "component", "library")
OPINION_WORDS = ("inbox", "dump", "archive", "project", "job", "spec", "index")
# Answers that accept a proposal.
AFFIRMATIVES = ("yes", "y", "yep", "yeah", "ok", "okay", "sure", "correct", "confirm", "confirmed", "right", "sounds good", "looks good")


def manifest_table(manifests: DataFrame) -> DataFrame:
    """(manifest_id, ord, kind, folder, level, parent, purpose): heading lines are folders, list
    lines files of the folder above, other lines residue. A first-level heading resets."""
    lines = manifests.select("manifest_id", F.posexplode(F.split("content", "\r?\n")).alias("ord", "line")).filter(trimmed(F.col("line")) != "")
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", TOC, 1)))
    lines = lines.withColumn("name", F.regexp_replace(trimmed(F.regexp_extract("line", TOC, 2)), "/$", "")).withColumn("note", F.regexp_extract("line", TOC, 3))
    order = W.partitionBy("manifest_id").orderBy("ord")
    head = F.when(F.col("level") > 0, F.struct("ord", "level", "name"))
    lines = lines.withColumn("root", F.coalesce(F.max(F.when(F.col("level") == 1, F.col("ord"))).over(order), F.lit(-1)))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    for k in range(2, 6):  # the last heading that could stand above, level by level
        above = F.when((F.col("level") > 0) & (F.col("level") <= k), F.struct("ord", "level", "name"))
        lines = lines.withColumn(f"up{k}", F.last(above, ignorenulls=True).over(before))
    lines = lines.withColumn("current", F.last(head, ignorenulls=True).over(order))
    usable = lambda k: (F.col("level") > k) & (F.col(f"up{k}.level") == k) & (F.col(f"up{k}.ord") > F.col("root"))
    parent = F.coalesce(*[F.when(usable(k), F.col(f"up{k}.name")) for k in range(5, 1, -1)])
    is_file = (F.col("level") == 0) & F.col("line").rlike(TOC_FILE) & (F.col("current.level") > 1)
    kind = F.when(F.col("level") > 1, "folder").when(F.col("level") == 1, "root").when(is_file, "file").otherwise("residue")
    return lines.select(
        "manifest_id",
        "ord",
        kind.alias("kind"),
        F.when(F.col("level") > 0, F.col("name")).when(is_file, trimmed(F.regexp_extract("line", TOC_FILE, 1))).otherwise(F.col("line")).alias("folder"),
        "level",
        F.when(is_file, F.col("current.name")).otherwise(parent).alias("parent"),
        F.when(is_file, F.regexp_extract("line", TOC_FILE, 2)).otherwise(F.col("note")).alias("purpose"),
    )


def content_type_defaults(manifest: DataFrame) -> DataFrame:
    """(folder, content_type) by the words of the folder's name."""
    low = F.lower("folder")
    kind = F.when(low.rlike("|".join(REFERENCE_WORDS)), "reference").when(low.rlike("|".join(OPINION_WORDS)), "narrative-opinion").otherwise("reference")
    return manifest.filter("kind = 'folder'").select("folder", kind.alias("content_type")).distinct()


def inherit_content_type(files: DataFrame, defaults: DataFrame) -> DataFrame:
    """(file_id, content_type): that of the file's folder, else of the nearest ancestor."""
    ups = files.select("file_id", F.posexplode(ancestors(F.col("folder"))).alias("depth", "folder"))
    near = ups.join(defaults, "folder").groupBy("file_id").agg(F.max_by("content_type", "depth").alias("content_type"))
    return files.select("file_id").join(near, "file_id", "left")


def folder_files(files: DataFrame) -> DataFrame:
    """(folder, n_files, names): direct files of each folder in order; ancestors without files
    are there with none."""
    own = files.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sort_array(F.collect_list(F.element_at(F.split("path", "/"), -1))).alias("names"))
    ups = files.select("folder").distinct().select(F.explode(ancestors(F.col("folder"))).alias("folder")).distinct()
    return ups.join(own, "folder", "full").select("folder", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def uncovered_folders(folders: DataFrame, manifest: DataFrame) -> DataFrame:
    """Folders that no manifest entry names, bare or under its parent."""
    named = manifest.filter("kind = 'folder'")
    covered = named.select(F.col("folder")).unionByName(named.filter("parent IS NOT NULL").select(F.concat_ws("/", "parent", "folder").alias("folder"))).distinct()
    return folders.filter("folder <> ''").join(covered, "folder", "left_anti")


def folder_top_links(edges: DataFrame, files: DataFrame, k: int = 6) -> DataFrame:
    """(folder, dst_key, n): the most frequent link targets of a folder, ties by name."""
    rows = edges.filter("kind = 'wikilink'").withColumn("file_id", file_of(F.col("src_key"))).join(files.select("file_id", "folder"), "file_id")
    counts = rows.groupBy("folder", "dst_key").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("folder").orderBy(F.col("n").desc(), F.col("dst_key"))
    return counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def folder_headings(sections: DataFrame, files: DataFrame, k: int = 3) -> DataFrame:
    """(folder, node_key, heading_text, text): up to k headed sections with text of a folder."""
    rows = sections.filter("heading_text <> '' AND text <> ''").join(files.select("file_id", "folder"), "file_id")
    order = W.partitionBy("folder").orderBy("node_key")
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("folder", "node_key", "heading_text", "text")


def folder_digest(folders: DataFrame, links: DataFrame, heads: DataFrame, purposes: DataFrame | None = None) -> DataFrame:
    """(folder, digest): file names, top links and 100-character snippets of each folder."""
    tied = links.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "dst_key"))), lambda x: x["dst_key"]), ", ").alias("links"))
    snippet = F.concat(F.lit("- "), "heading_text", F.lit(": "), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 100))
    shown = heads.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_key", snippet.alias("s")))), lambda x: x["s"]), "\n").alias("heads"))
    rows = folders.join(tied, "folder", "left").join(shown, "folder", "left")
    title = F.when(F.col("folder") == "", "(root)").otherwise(F.col("folder"))
    if purposes is not None:
        rows = rows.join(purposes.select("folder", "purpose"), "folder", "left")
        title = F.concat(title, F.coalesce(F.concat(F.lit(" — "), F.col("purpose")), F.lit("")))
    text = F.concat_ws("\n", F.concat(title, F.lit("/")), F.concat(F.lit("files: "), F.array_join(F.slice("names", 1, 20), ", ")), F.concat(F.lit("links: "), "links"), "heads")
    return rows.select("folder", text.alias("digest"))


def parse_purposes(completions: DataFrame, folders: DataFrame, max_chars: int = 200) -> DataFrame:
    """(folder, purpose) of ``folder — purpose`` lines: exact name, then any case, then by prefix;
    the last line of a folder holds."""
    lines = completions.select("batch_id", F.posexplode(F.split("completion", "\r?\n")).alias("i", "line"))
    line = F.regexp_replace(trimmed(F.col("line")), r"\A[*-]\s*", "")
    rows = lines.select("batch_id", "i", line.alias("line")).filter(F.col("line").contains("—"))
    token = F.regexp_replace(trimmed(F.substring_index("line", "—", 1)), "/$", "")
    purpose = trimmed(F.expr("substring(line, instr(line, '—') + 1)"))
    rows = rows.select("batch_id", "i", token.alias("token"), purpose.alias("purpose")).filter((F.col("purpose") != "") & ~F.col("purpose").startswith("[") & (F.length("purpose") <= max_chars))
    clean = folders.select("folder", F.regexp_replace("folder", "/$", "").alias("name"))
    starts = clean.select("folder", F.explode(F.array_union(F.array(F.substring_index("name", " (", 1)), ancestors(F.col("name")))).alias("token")).filter("token <> folder")
    ranked = (
        rows.join(clean.select("folder", F.col("name").alias("token")), "token").withColumn("rank", F.lit(0))
        .unionByName(rows.withColumn("low", F.lower("token")).join(clean.select("folder", F.lower("name").alias("low")), "low").drop("low").withColumn("rank", F.lit(1)))
        .unionByName(rows.join(starts, "token").withColumn("rank", F.lit(2)))
    )
    one = ranked.groupBy("batch_id", "i", "token", "purpose").agg(F.min(F.struct("rank", "folder")).alias("m"))
    last = W.partitionBy("folder").orderBy(F.col("batch_id").desc(), F.col("i").desc())
    return one.select(F.col("m.folder").alias("folder"), "purpose", "batch_id", "i").withColumn("n", F.row_number().over(last)).filter("n = 1").select("folder", "purpose")


def match_folder_in_question(questions: DataFrame, folders: DataFrame) -> DataFrame:
    """(q_id, folder): the longest folder path in the question, else the one folder whose last
    part is in it and belongs to no other. Folders start at a place of the question: pairs come
    from the folder's first five characters, not from all questions with all folders."""
    size = 5
    asked = questions.select("q_id", "question")
    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("question"), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.substring(F.col("question"), i, k)))))
    grams = asked.select("q_id", F.explode(starts).alias("gram"))
    base = F.element_at(F.split("folder", "/"), -1)
    names = folders.filter("folder <> ''").select("folder", base.alias("base"))
    lone = names.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("folder").alias("folder")).filter("n = 1")
    forms = names.select("folder", F.col("folder").alias("form"), F.lit(0).alias("rank")).unionByName(lone.select("folder", F.col("base").alias("form"), F.lit(1).alias("rank")))
    met = forms.withColumn("gram", F.substring("form", 1, size)).join(grams, "gram").join(asked, "q_id").filter(F.col("question").contains(F.col("form")))
    best = F.min(F.struct("rank", (-F.length("folder")).alias("l"), "folder")).alias("m")
    return met.groupBy("q_id").agg(best).select("q_id", F.col("m.folder").alias("folder"))


def resolve_purposes(answers: DataFrame, folders: DataFrame, max_chars: int = 120) -> DataFrame:
    """(folder, purpose) from answered questions (q_id, turn, question, answer): the last answer
    for a folder; an accepting answer takes the wording quoted in the question."""
    rows = answers.join(match_folder_in_question(answers, folders), "q_id")
    said = F.regexp_replace(F.lower(trimmed(F.col("answer"))), r"[.!?,]+$", "")
    yes = said.isin(*AFFIRMATIVES) | said.rlike(r"\A(?:" + "|".join(AFFIRMATIVES) + ") ")
    quoted = trimmed(F.regexp_extract("question", "([\"'“”`])([^\"'“”`]{2,})\\1", 2))
    taken = yes & (quoted != "") & (quoted != F.col("folder")) & (quoted != F.element_at(F.split("folder", "/"), -1))
    text = F.when(taken, quoted).otherwise(F.col("answer"))
    clean = F.substring(trimmed(F.regexp_replace(F.regexp_replace(text, "<!--|-->", ""), r"\s+", " ")), 1, max_chars)
    last = rows.groupBy("folder").agg(F.max_by(clean, "turn").alias("purpose"))
    return last.filter("purpose <> ''")
