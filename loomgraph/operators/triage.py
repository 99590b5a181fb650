"""Triage of inbox notes: candidates, eligibility, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip_frontmatter
from ..sources.corpus import ignore_filter
from ..sources.scratch import written
from .vectors import embed, hash_vectors, vector_topk


def units(notes: DataFrame, inbox: str, journal: DataFrame | None = None) -> DataFrame:
    """(unit_id, handle, text, idempotency_key) of the notes in the inbox folder that the journal
    has not placed or flagged yet."""
    key = F.concat(F.lit("sha1:"), F.substring(F.sha1("content"), 1, 16))
    rows = notes.filter(F.col("path").startswith(inbox.rstrip("/") + "/")).select(F.col("path").alias("unit_id"), F.col("path").alias("handle"), F.col("content").alias("text"), key.alias("idempotency_key"))
    if journal is None:
        return rows
    return rows.join(journal.filter("state IN ('placed', 'flagged')").select("idempotency_key"), "idempotency_key", "left_anti").select(*rows.columns)


def candidates(unit_rows: DataFrame, sections: DataFrame, k: int = 5, overscan: int = 3, embed_fn=hash_vectors) -> DataFrame:
    """(unit_id, node_key, file_id, heading_path, score, rank): k x overscan nearest sections."""
    texts = unit_rows.select("unit_id", strip_frontmatter(F.col("text")).alias("body"))
    # Both are read once a block of units, and the sections again for their paths: vectors are made once.
    asked = written(embed(texts, "body", embed_fn).select(F.col("unit_id").alias("q_id"), "embedding"), "units")
    sections = written(sections.select("node_key", "file_id", "heading_path", "embedding"), "sections")
    top = vector_topk(asked, sections.select(F.col("node_key").alias("item_id"), "embedding"), k * overscan)
    return top.withColumnRenamed("q_id", "unit_id").withColumnRenamed("item_id", "node_key").join(sections.select("node_key", "file_id", "heading_path"), "node_key").select("unit_id", "node_key", "file_id", "heading_path", "score", "rank")


def eligibility(found: DataFrame, source_set: DataFrame | None = None, scope: list[str] | None = None, files: DataFrame | None = None, near_dup: float = 0.97, reference_order: bool = False) -> DataFrame:
    """``found`` plus ``verdict``: self, near_dup, source_set, out_of_scope, stale or eligible -
    the first that applies. ``reference_order`` tests near duplicates before self. ``files``
    (file_id, content_hash, current_hash) tells stale rows."""
    rows = found
    in_set, stale = F.lit(False), F.lit(False)
    if source_set is not None:
        rows = rows.join(source_set.select("file_id", F.lit(True).alias("_src")).distinct(), "file_id", "left")
        in_set = F.coalesce("_src", F.lit(False))
    if files is not None:
        rows = rows.join(files.select("file_id", (F.col("content_hash") != F.col("current_hash")).alias("_stale")), "file_id", "left")
        stale = F.coalesce("_stale", F.lit(False))
    out = F.lit(False)
    if scope:
        inside = F.lit(False)
        for p in scope:
            inside = inside | F.col("file_id").startswith(p)
        out = ~inside
    near, own = F.col("score") >= near_dup, F.col("file_id") == F.col("unit_id")
    first, second = ((near, "near_dup"), (own, "self")) if reference_order else ((own, "self"), (near, "near_dup"))
    verdict = F.when(first[0], first[1]).when(second[0], second[1]).when(in_set, "source_set").when(out, "out_of_scope").when(stale, "stale").otherwise("eligible")
    return rows.withColumn("verdict", verdict).drop("_src", "_stale")


def score_candidates(unit_rows: DataFrame, sections: DataFrame, k: int = 5, overscan: int = 3, embed_fn=hash_vectors, **rules) -> DataFrame:
    """Candidates with verdicts: every near duplicate, and at most k eligible ones by rank."""
    judged = eligibility(candidates(unit_rows, sections, k, overscan, embed_fn), **rules)
    order = W.partitionBy("unit_id", "verdict").orderBy("rank")
    return judged.withColumn("n", F.row_number().over(order)).filter((F.col("verdict") == "near_dup") | ((F.col("verdict") == "eligible") & (F.col("n") <= k))).drop("n")


def drop_ignored_candidates(found: DataFrame, patterns: list[str]) -> DataFrame:
    return ignore_filter(found, patterns, "file_id")


def decide(unit_rows: DataFrame, found: DataFrame, floor: float = 0.6) -> DataFrame:
    """(unit_id, action, node_key, file_id, score): one near_dup row per near duplicate, and one
    of placed (top at the floor), flagged (below it) or no_destination."""
    dup = found.filter("verdict = 'near_dup'").select("unit_id", F.lit("near_dup").alias("action"), "node_key", "file_id", "score")
    best = found.filter("verdict = 'eligible'").groupBy("unit_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "node_key", "file_id")).alias("m"))
    rows = unit_rows.select("unit_id").join(best, "unit_id", "left")
    action = F.when(F.col("m").isNull(), "no_destination").when(-F.col("m.s") >= floor, "placed").otherwise("flagged")
    return dup.unionByName(rows.select("unit_id", action.alias("action"), F.col("m.node_key").alias("node_key"), F.col("m.file_id").alias("file_id"), (-F.col("m.s")).alias("score")))


def destination_context(decisions: DataFrame, notes: DataFrame, lines: int = 5) -> DataFrame:
    """(unit_id, node_key, before, after): the lines around the first line that holds the last
    heading of the destination."""
    want = decisions.filter("node_key IS NOT NULL").select("unit_id", "node_key", "file_id", F.element_at(F.split(F.substring_index("node_key", "::", -1), " › "), -1).alias("heading"))
    body = notes.select(F.col("path").alias("file_id"), F.split("content", "\n").alias("all"))
    rows = want.join(body, "file_id")
    at = F.array_position(F.transform("all", lambda x: x.contains(F.col("heading"))), True).cast("int")
    rows = rows.withColumn("at", F.when(F.col("heading") == "", 1).otherwise(at))
    start = F.greatest(F.col("at") - lines, F.lit(1))
    before = F.array_join(F.slice("all", start, F.greatest(F.col("at") - start, F.lit(0))), "\n")
    after = F.array_join(F.slice("all", F.col("at") + 1, F.lit(lines)), "\n")
    none = F.col("at") == 0
    return rows.select("unit_id", "node_key", F.when(none, "").otherwise(before).alias("before"), F.when(none, "").otherwise(after).alias("after"))


def triage_report(decisions: DataFrame) -> DataFrame:
    """(action, n, line): counts of each action and a text line."""
    counts = decisions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("action", "n", F.concat("action", F.lit(": "), F.col("n").cast("string")).alias("line"))


def unchanged_check(before: DataFrame, after: DataFrame, key: str = "file_id") -> DataFrame:
    """(n_compared, n_changed) over content hashes of rows on both sides; missing ones count."""
    both = before.select(key, F.col("content_hash").alias("a")).join(after.select(key, F.col("content_hash").alias("b")), key, "left")
    return both.agg(F.count(F.lit(1)).alias("n_compared"), F.coalesce(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")), F.lit(0)).alias("n_changed"))
