"""Typed edges between sections, expansion and key resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import file_of, normalize_relation, trimmed
from ..sources.scratch import written
from .entities import WIKILINK
from .vectors import similar_pairs


def wikilink_edges(sections: DataFrame, files: DataFrame, resolve_links: bool = False) -> DataFrame:
    """(src_key, dst_key, kind, weight): one edge a link target; ``Note#Heading`` points to
    ``Note::Heading``. Weight 1.0 if the target is a file path of the corpus, else 0.5. With
    ``resolve_links`` bare names count as the one file of that name."""
    raw = sections.select(F.col("node_key").alias("src_key"), F.explode(F.transform(F.regexp_extract_all("text", F.lit(WIKILINK), 1), trimmed)).alias("target"))
    anchored = F.concat(trimmed(F.split("target", "#")[0]), F.lit("::"), trimmed(F.get(F.split("target", "#"), F.lit(1))))
    links = raw.withColumn("dst_key", F.when(F.col("target").contains("#"), anchored).otherwise(F.col("target"))).filter("dst_key <> src_key")
    links = links.groupBy("src_key", "dst_key").agg(F.min("target").alias("target"))
    paths = files.select(F.col("file_id").alias("target"), F.lit(True).alias("known"))
    if resolve_links:
        name = F.regexp_replace(F.element_at(F.split("file_id", "/"), -1), r"\.md\z", "")
        bare = files.select(name.alias("target"), "file_id").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("file_id")).filter("n = 1")
        links = links.withColumn("name", F.regexp_replace(F.substring_index("target", "#", 1), r"\.md\z", "")).join(bare.select(F.col("target").alias("name"), "file_id"), "name", "left")
        tail = F.when(F.col("dst_key").contains("::"), F.concat(F.lit("::"), F.substring_index("dst_key", "::", -1))).otherwise("")
        links = links.withColumn("dst_key", F.when(F.col("file_id").isNotNull(), F.concat("file_id", tail)).otherwise(F.col("dst_key"))).withColumn("target", F.coalesce("file_id", "target"))
    out = links.join(paths.distinct(), "target", "left")
    weight = F.when(F.col("known") | F.col("dst_key").isNull(), 1.0).otherwise(0.5)
    return out.select("src_key", "dst_key", F.lit("wikilink").alias("kind"), weight.alias("weight")).groupBy("src_key", "dst_key", "kind").agg(F.max("weight").alias("weight"))


def backlink_edges(wikilinks: DataFrame) -> DataFrame:
    """Reversed links at 0.8, and from the target to the source's file at 0.7; the 0.8 row holds."""
    back = wikilinks.select(F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"), F.lit(0.8).alias("weight"))
    file = wikilinks.filter(F.col("src_key").contains("::")).select(F.col("dst_key").alias("src_key"), file_of(F.col("src_key")).alias("dst_key"), F.lit(0.7).alias("weight"))
    return back.unionByName(file).groupBy("src_key", "dst_key").agg(F.max("weight").alias("weight")).select("src_key", "dst_key", F.lit("backlink").alias("kind"), "weight")


def inferred_edges(sections: DataFrame, linked: DataFrame, threshold: float = 0.7, max_per_section: int = 3, method: str = "cells") -> DataFrame:
    items = sections.select(F.col("node_key").alias("item_id"), "embedding")
    skip = linked.select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))
    pairs = similar_pairs(items, threshold, max_per_section, skip, method)
    return pairs.select(F.col("src").alias("src_key"), F.col("dst").alias("dst_key"), F.lit("inferred").alias("kind"), F.col("score").alias("weight"))


def build_edges(sections: DataFrame, files: DataFrame, threshold: float = 0.7, max_per_section: int = 3, method: str = "cells") -> DataFrame:
    """All structural edges: links, backlinks and, where sections have vectors, inferred ones."""
    links = written(wikilink_edges(sections, files), "links")  # read by all three kinds
    out = links.unionByName(backlink_edges(links))
    if "embedding" in sections.columns:
        out = out.unionByName(inferred_edges(sections, links, threshold, max_per_section, method))
    return out


def edges_for_files(edges: DataFrame, file_ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges out of files; ``semantic`` stands for every ``semantic:*`` kind."""
    rows = edges.withColumn("src_file", file_of(F.col("src_key")))
    if kinds:
        hit = F.col("kind").isin([k for k in kinds if k != "semantic"])
        rows = rows.filter(hit | F.col("kind").startswith("semantic:") if "semantic" in kinds else hit)
    return rows.join(file_ids.select(F.col("file_id").alias("src_file")).distinct(), "src_file", "left_semi").drop("src_file")


def semantic_edges(relations: DataFrame, mentions: DataFrame, max_per_relation: int = 4) -> DataFrame:
    """Edges of relations (src, dst, relation) between sections that mention their ends (mentions:
    name, section_key), at most ``max_per_relation`` each in (source, target) order. Of each end
    only the first sections that can matter are joined, so a frequent name makes no product."""
    first = W.partitionBy("name").orderBy("section_key")
    near = mentions.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= max_per_relation + 1)
    a = near.select(F.col("name").alias("src"), F.col("section_key").alias("src_key"))
    b = near.select(F.col("name").alias("dst"), F.col("section_key").alias("dst_key"))
    pairs = relations.select("src", "dst", "relation").distinct().join(a, "src").join(b, "dst").filter("src_key <> dst_key")
    order = W.partitionBy("src", "dst", "relation").orderBy("src_key", "dst_key")
    kept = pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_per_relation)
    return kept.select("src_key", "dst_key", normalize_relation(F.col("relation")).alias("kind"), F.lit(1.0).alias("weight")).distinct()


def unlinked_sections(sections: DataFrame, edges: DataFrame) -> DataFrame:
    """Sections at neither end of a link or backlink."""
    tied = edges.filter(F.col("kind").isin("wikilink", "backlink"))
    ends = tied.select(F.col("src_key").alias("node_key")).unionByName(tied.select(F.col("dst_key").alias("node_key")))
    return sections.join(ends, "node_key", "left_anti")


def resolve_keys(keys: DataFrame, sections: DataFrame, files: DataFrame) -> DataFrame:
    """(key, node_key, file_id, heading_path): a section by its exact key; else all sections of
    the file that has the key as path, with or without ``.md``, or as a path suffix."""
    want = keys.select("key").distinct()
    exact = want.join(sections.select(F.col("node_key").alias("key"), "node_key", "file_id", "heading_path"), "key")
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    names = files.select("file_id", F.explode(tails).alias("tail")).select("file_id", F.explode(F.array("tail", F.regexp_replace("tail", r"\.md\z", ""))).alias("key")).distinct()
    rest = want.join(exact.select("key"), "key", "left_anti").join(names, "key")
    loose = rest.join(sections.select("file_id", "node_key", "heading_path"), "file_id").select("key", "node_key", "file_id", "heading_path")
    return exact.unionByName(loose)


def expand_neighbors(seeds: DataFrame, edges: DataFrame, depth: int = 1, max_fan_out: int = 8) -> DataFrame:
    """(q_id, node_key, level, pos): breadth-first from ``seeds`` (q_id, node_key, pos) in
    discovery order. Every node keeps its ``max_fan_out`` best out-edges that are not inferred;
    each level is one join and one anti-join."""
    best = W.partitionBy("src_key").orderBy(F.col("weight").desc(), F.col("dst_key"))
    out = edges.filter("kind <> 'inferred'").withColumn("e", F.row_number().over(best)).filter(F.col("e") <= max_fan_out).select(F.col("src_key").alias("node_key"), "dst_key", "e")
    first = F.min(F.struct("level", "rank")).alias("m")
    seen = seeds.filter("node_key IS NOT NULL AND node_key <> ''").select("q_id", "node_key", F.lit(0).alias("level"), F.array(F.col("pos").cast("long")).alias("rank"))
    seen = seen.groupBy("q_id", "node_key").agg(first).select("q_id", "node_key", "m.*")
    if depth > 1:  # read at each level
        out = written(out, "out-edges")
    frontier = seen
    for level in range(1, depth + 1):
        # A node's rank is its parent's rank with the edge's place appended: discovery order.
        met = frontier.join(out, "node_key").select("q_id", F.col("dst_key").alias("node_key"), F.lit(level).alias("level"), F.concat("rank", F.array(F.col("e").cast("long"))).alias("rank"))
        met = met.groupBy("q_id", "node_key").agg(first).select("q_id", "node_key", "m.*")
        frontier = met.join(seen.select("q_id", "node_key"), ["q_id", "node_key"], "left_anti")
        if level < depth:  # the next level reads it three times
            frontier = written(frontier, "frontier")
        seen = seen.unionByName(frontier)
    pos = F.row_number().over(W.partitionBy("q_id").orderBy("level", "rank", "node_key"))
    return seen.select("q_id", "node_key", "level", pos.alias("pos"))
