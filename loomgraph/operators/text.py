"""Sections, frontmatter, outlines and views of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import FRONTMATTER, SEP, first_words, strip_frontmatter, trimmed, word_count

HEADING = r"\A(#{1,6})\s+(.+)\z"


def body_lines(content: Column) -> Column:
    return F.split(F.regexp_replace(strip_frontmatter(content), "\r\n", "\n"), "\n")


def _headings(lines: Column) -> Column:
    """(i, level, text) of the heading lines, in order."""
    each = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), trimmed(F.regexp_extract(x, HEADING, 2)).alias("text")))
    return F.filter(each, lambda h: h["level"] > 0)


def _with_paths(headings: Column) -> Column:
    """Each heading with the texts of the headings above it: a fold whose stack drops what is
    not above the new heading. Narrow: no line is shuffled."""
    start = F.expr("named_struct('stack', cast(array() as array<struct<level:int,text:string>>), 'out', cast(array() as array<string>))")

    def step(a: Column, h: Column) -> Column:
        above = F.filter(a["stack"], lambda s: s["level"] < h["level"])
        stack = F.concat(above, F.array(F.struct(h["level"].cast("int").alias("level"), h["text"].alias("text"))))
        return F.struct(stack.alias("stack"), F.concat(a["out"], F.array(F.array_join(F.transform(stack, lambda s: s["text"]), SEP))).alias("out"))

    return F.aggregate(headings, start, step, lambda a: a["out"])


def chunk_sections(notes: DataFrame) -> DataFrame:
    """Heading-delimited sections: node_key, file_id, heading_path, heading_text, line_start,
    line_end (1-based within the body), text, content_hash. Text before the first heading and
    empty sections are dropped; a note without headings is one root section."""
    lined = notes.select(F.col("path").alias("file_id"), body_lines(F.col("content")).alias("lines"))
    found = lined.select("file_id", "lines", _headings(F.col("lines")).alias("h"))
    found = found.select("file_id", "lines", "h", _with_paths(F.col("h")).alias("paths"), F.size("lines").alias("n"))

    def section(h: Column, k: Column) -> Column:
        end = F.coalesce(F.get("h", k + 1)["i"], F.col("n"))
        text = trimmed(F.array_join(F.slice("lines", h["i"] + 2, end - h["i"] - 1), "\n"))
        return F.struct(F.get("paths", k).alias("heading_path"), h["text"].alias("heading_text"), (h["i"] + 2).alias("line_start"), end.alias("line_end"), text.alias("text"))

    whole = F.array(F.struct(F.lit("").alias("heading_path"), F.lit("").alias("heading_text"), F.lit(0).alias("line_start"), F.col("n").alias("line_end"), trimmed(F.array_join("lines", "\n")).alias("text")))
    rows = found.select("file_id", F.explode(F.when(F.size("h") > 0, F.transform("h", section)).otherwise(whole)).alias("s"))
    rows = rows.select("file_id", "s.*").filter(F.col("text") != "")
    key = F.concat("file_id", F.lit("::"), "heading_path")
    return rows.select(key.alias("node_key"), "file_id", "heading_path", "heading_text", "line_start", "line_end", "text", F.sha1("text").alias("content_hash"))


def unique_sections(sections: DataFrame) -> DataFrame:
    """One row a node_key: the last in the file, as a replacing write keeps it."""
    last = W.partitionBy("node_key").orderBy(F.col("line_start").desc())
    return sections.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def frontmatter_table(notes: DataFrame) -> DataFrame:
    """(path, key, pos, value): flat keys with scalars, inline lists and indented item lists."""
    block = F.regexp_extract("content", FRONTMATTER, 1)
    lines = notes.select("path", F.posexplode(F.split(block, "\r?\n")).alias("i", "raw")).withColumn("line", trimmed(F.col("raw")))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    is_key = ~F.col("raw").rlike(r"\A\s") & F.col("line").contains(":")
    rest = trimmed(F.expr("substring(line, instr(line, ':') + 1)"))
    lines = lines.withColumn("own", F.when(is_key, trimmed(F.substring_index("line", ":", 1)))).withColumn("rest", F.when(is_key, rest))
    order = W.partitionBy("path").orderBy("i")
    last = F.last(F.when(F.col("own").isNotNull(), F.struct("own", "rest")), ignorenulls=True).over(order)
    lines = lines.withColumn("head", last)
    quoted = lambda v: F.when(v.rlike(r"""\A(".*"|'.*')\z""") & (F.length(v) > 1), F.expr("substring(v, 2, length(v) - 2)")).otherwise(v)
    inline = F.col("rest").rlike(r"(?s)\A\[.*\]\z")
    listed = F.filter(F.transform(F.split(F.expr("substring(rest, 2, length(rest) - 2)"), ","), trimmed), lambda v: v != "")
    item = F.col("own").isNull() & F.col("raw").rlike(r"\A\s+- ") & (F.col("head.rest") == "")
    values = F.when(F.col("own").isNotNull() & (F.col("rest") != ""), F.when(inline, listed).otherwise(F.array("rest"))).when(item, F.array(trimmed(F.expr("substring(line, 3)"))))
    rows = lines.withColumn("values", values).filter("values IS NOT NULL").select("path", F.col("head.own").alias("key"), "i", F.posexplode("values").alias("j", "v"))
    nth = F.row_number().over(W.partitionBy("path", "key").orderBy("i", "j")) - 1
    return rows.select("path", "key", nth.alias("pos"), quoted(F.col("v")).alias("value"))


def extract_tags(frontmatter: DataFrame) -> DataFrame:
    """(path, pos, tag) of the ``tags`` key, listed or comma-separated."""
    rows = frontmatter.filter("key = 'tags'").select("path", "pos", F.posexplode(F.split("value", ",")).alias("j", "tag"))
    rows = rows.withColumn("tag", trimmed(F.col("tag"))).filter("tag <> ''")
    return rows.select("path", (F.row_number().over(W.partitionBy("path").orderBy("pos", "j")) - 1).alias("pos"), "tag")


def inline_tags(content: Column) -> Column:
    """The tags of the frontmatter's inline ``tags`` list as an array, without a shuffle."""
    block = F.regexp_extract(content, FRONTMATTER, 1)
    raw = F.regexp_extract(block, r"(?m)^tags:[ \t]*\[?([^\]\r\n]*)", 1)
    return F.filter(F.transform(F.split(raw, ","), trimmed), lambda t: t != "")


def heading_outline(notes: DataFrame, cap: int = 30) -> DataFrame:
    """(path, outline): the first ``cap`` heading lines."""
    lines = F.filter(body_lines(F.col("content")), lambda x: x.rlike(r"\A#{1,6}\s+"))
    return notes.select("path", F.transform(F.slice(lines, 1, cap), trimmed).alias("outline"))


def file_rollup(sections: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """(file_id, rollup): the first ``limit`` leaf headings of a file; verbatim files have none."""
    rows = sections.filter("heading_text <> ''")
    if "granularity" in files.columns:
        rows = rows.join(files.filter("granularity = 'verbatim'").select("file_id"), "file_id", "left_anti")
    nth = F.row_number().over(W.partitionBy("file_id").orderBy("line_start", "node_key"))
    top = rows.select("file_id", "heading_text", nth.alias("n")).filter(F.col("n") <= limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "heading_text"))), lambda x: x["heading_text"]), ", ")
    return top.groupBy("file_id").agg(F.concat(F.lit("Sections: "), joined).alias("rollup"))


def note_view(notes: DataFrame, n: int = 200) -> DataFrame:
    """Path, word count, tags, outline and the first words of each note."""
    body = strip_frontmatter(F.col("content"))
    outline = F.transform(F.slice(F.filter(body_lines(F.col("content")), lambda x: x.rlike(r"\A#{1,6}\s+")), 1, 30), trimmed)
    return notes.select("path", word_count(body).alias("n_words"), inline_tags(F.col("content")).alias("tags"), outline.alias("outline"), first_words(body, n).alias("excerpt"))
