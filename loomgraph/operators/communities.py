"""Communities of sections, their members, context packs and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import plain
from ..functions.text import estimate_tokens, short_key, trimmed
from ..sources.scratch import written
from .entities import offline_completion, run_completions
from .ranges import positioned, within_budget
from .vectors import PLACES, embed, hash_vectors, vector_topk

GROUP_ROWS = 8192  # of a sequential fold
PIVOTS = 256  # cells at most of means that key order does not bring together


def seed_table(manifest: DataFrame) -> DataFrame:
    """(community_id, seed_source, label, path, text, ord) of the first two levels of a folder
    table (folder, level, parent, purpose, ord)."""
    top = manifest.filter("level = 2").select(F.col("folder").alias("path"), F.col("folder").alias("label"), F.col("folder").alias("name"), F.lit(None).cast("string").alias("up"), "purpose", "ord")
    low = manifest.filter("level = 3").select(F.concat_ws("/", "parent", "folder").alias("path"), F.concat_ws("/", "parent", "folder").alias("label"), F.col("folder").alias("name"), F.col("parent").alias("up"), "purpose", "ord")
    rows = top.unionByName(low)
    text = F.concat_ws(" ", F.col("path"), F.nullif("purpose", F.lit("")))
    return rows.select(short_key(F.col("path")).alias("community_id"), F.lit("manifest").alias("seed_source"), "label", "path", text.alias("text"), "ord")


def embed_seeds(seeds: DataFrame, embed_fn=hash_vectors) -> DataFrame:
    """``seeds`` plus ``embedding`` of the seed text, else of the label; a failure leaves an empty
    vector, which never wins."""
    chosen = seeds.withColumn("_text", F.when(trimmed(F.col("text")) != "", F.col("text")).otherwise(F.col("label")))
    return embed(chosen, "_text", embed_fn).drop("_text")


def assign_seeded(sections: DataFrame, seeds: DataFrame) -> DataFrame:
    """(section_key, community_id, score): the best seed by cosine, the first seed on ties.
    Seeds (item_id order = ord) number the folders of a manifest; they are taken in blocks."""
    order = seeds.select(F.col("ord").alias("q_id"), "embedding").filter(F.size("embedding") > 0)
    items = sections.filter(F.size("embedding") > 0).select(F.col("node_key").alias("item_id"), "embedding")
    spark = sections.sparkSession
    count = order.count()
    block = 4096
    best: DataFrame | None = None
    for b in range(max(1, -(-count // block))):
        part = order.filter(F.pmod(F.xxhash64("q_id"), F.lit(-(-count // block) or 1)) == b)
        shared = spark.sparkContext.broadcast(sorted((r["q_id"], list(r["embedding"])) for r in part.collect()))

        def run(batches, shared=shared):
            from .vectors import _unit

            ids = np.array([i for i, _ in shared.value])
            q = _unit([v for _, v in shared.value])
            for rows in batches:
                v = _unit(rows["embedding"].tolist())
                if len(ids) and v.shape[1] == q.shape[1]:
                    score = np.round(v @ q.T, PLACES)
                    top = score.argmax(axis=1)
                    yield pd.DataFrame({"section_key": rows["item_id"].astype(object), "ord": ids[top], "score": score[np.arange(len(top)), top]})

        found = items.mapInPandas(run, "section_key string, ord long, score double")
        best = found if best is None else best.unionByName(found)
    one = best.groupBy("section_key").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("m"))
    one = one.select("section_key", (-F.col("m.o")).alias("ord"), F.col("m.score").alias("score"))
    return one.join(seeds.select(F.col("ord").cast("long").alias("ord"), "community_id"), "ord").select("section_key", "community_id", "score")


def _fold(keys: list[str], vectors: list, counts: list[int], threshold: float) -> list[int]:
    """The leader fold: in order, each vector joins the best running mean at the threshold or
    opens a cluster; ties go to the earlier cluster. Returns the cluster of each."""
    sums: list[np.ndarray] = []
    sizes: list[int] = []
    unit = np.zeros((16, len(vectors[0]) if vectors else 1))
    out = []
    for v, n in zip(vectors, counts, strict=True):
        x = np.asarray(v, float)
        norm = np.sqrt((x * x).sum())
        best, at = -1.0, -1
        if sums:
            score = np.round(unit[: len(sums)] @ (x / norm if norm else x), PLACES)
            at = int(score.argmax())
            best = float(score[at])
        if at >= 0 and best >= threshold:
            sums[at] = (sums[at] * sizes[at] + x * n) / (sizes[at] + n)
            sizes[at] += n
        else:
            at = len(sums)
            sums.append(x.copy())
            sizes.append(n)
            if at == len(unit):
                unit = np.vstack([unit, np.zeros_like(unit)])
        m = np.sqrt((sums[at] * sums[at]).sum())
        unit[at] = sums[at] / m if m else sums[at]
        out.append(at)
    return out


def _merged(df: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One fold over weighted means in the order of their anchors: for each row the anchor and label
    of the cluster it joins, and on that cluster's first row its mean and size."""
    df = plain(df).sort_values("anchor")
    n = df["n"].to_numpy()
    at = np.array(_fold(df["anchor"].tolist(), df["mean"].tolist(), n.tolist(), threshold))
    _, first = np.unique(at, return_index=True)
    v = np.stack([np.asarray(x, float) for x in df["mean"]])
    sums, sizes = np.zeros((len(first), v.shape[1])), np.zeros(len(first), dtype=np.int64)
    np.add.at(sums, at, v * n[:, None])
    np.add.at(sizes, at, n)
    means = (sums / sizes[:, None]).tolist()
    return pd.DataFrame({"anchor": df["anchor"], "lead": df["anchor"].to_numpy()[first][at], "label": df["label"].to_numpy()[first][at], "mean": [means[c] for c in at], "n": sizes[at]})


def leader_cluster(sections: DataFrame, threshold: float = 0.5, blocks: int | None = None, rows_a_group: int = GROUP_ROWS) -> DataFrame:
    """(section_key, community_id, label): order-dependent leader clustering in key order.

    Up to ``rows_a_group`` sections are one sequential fold. Beyond that runs of so many consecutive
    keys are folded, each by itself, and leave weighted means; these are merged by the same fold
    in a tree, again in runs of so many, until one run holds all. Where a level in key order
    merges less than a tenth, the next one takes means that lie in one cell of a Voronoi
    partition together, and where that does not help either the clusters stay as they are. Runs are
    cut by position, so the result does not hang on partitions, and no task sees more than a run.
    ``blocks`` cuts the sections into so many runs instead."""
    rows = sections.filter(F.size("embedding") > 0).select(F.col("node_key").alias("section_key"), "heading_path", F.col("embedding").cast("array<double>").alias("embedding"))
    placed, n = positioned(rows, ["section_key", "heading_path"], "sections")
    size = max(1, -(-n // blocks)) if blocks else rows_a_group
    schema = "anchor string, lead string, label string, mean array<double>, n long"

    def leaf(df: pd.DataFrame) -> pd.DataFrame:
        return _merged(df.rename(columns={"section_key": "anchor", "heading_path": "label", "embedding": "mean"}).assign(n=1), threshold)

    leaves = written(placed.withColumn("run", F.expr(f"pos div {size}")).groupBy("run").applyInPandas(leaf, schema), "leaves")
    follow = leaves.select(F.col("anchor").alias("section_key"), F.col("lead").alias("anchor"))
    now = leaves.filter("anchor = lead").select("anchor", "label", "mean", "n")
    known = now.select("anchor", F.col("anchor").alias("lead"), "label")
    left, by_cell = now.count(), False
    while left > 1 and (n > size):
        if by_cell:
            runs = _by_cell(now, rows_a_group, min(PIVOTS, -(-left // rows_a_group)))
        else:
            at, left = positioned(now, ["anchor"], "means")
            runs = at.withColumn("run", F.expr(f"pos div {rows_a_group}").cast("string"))
        level = written(runs.groupBy("run").applyInPandas(lambda df: _merged(df, threshold), schema), "level")
        step = level.select("anchor", F.col("lead").alias("to"), F.col("label").alias("to_label"))
        known = written(known.select("anchor", F.col("lead").alias("was")).join(step.withColumnRenamed("anchor", "was"), "was").select("anchor", F.col("to").alias("lead"), F.col("to_label").alias("label")), "leads")
        now = level.filter("anchor = lead").select("anchor", "label", "mean", "n")
        before, left = left, now.count()
        if before <= rows_a_group and not by_cell:
            break
        if left > 0.9 * before:
            if by_cell:
                break
            by_cell = True
        else:
            by_cell = False
    cid = F.concat(F.lit("auto-"), F.substring(F.md5("lead"), 1, 16))
    return follow.join(known, "anchor").select("section_key", cid.alias("community_id"), F.coalesce(F.nullif("label", F.lit("")), F.col("lead")).alias("label"))


def _by_cell(means: DataFrame, most: int, cells: int) -> DataFrame:
    """``means`` with ``run``: those nearest to one of so many pivots, in runs of ``most``."""
    pivots = means.select("mean", F.md5("anchor").alias("h")).orderBy("h").limit(cells).collect()
    p = np.array([r["mean"] for r in pivots], dtype=float)
    norm = np.sqrt((p * p).sum(axis=1, keepdims=True))
    p = np.divide(p, norm, out=np.zeros_like(p), where=norm > 0)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield plain(b).assign(cell=[int((p @ np.asarray(v, float)).argmax()) for v in b["mean"]])

    celled = means.mapInPandas(nearest, "anchor string, label string, mean array<double>, n long, cell int")
    placed, _ = positioned(celled, ["cell", "anchor"], "celled")
    first = placed.groupBy("cell").agg(F.min("pos").alias("first"))
    run = F.concat_ws("-", "cell", ((F.col("pos") - F.col("first")) / most).cast("long"))
    return placed.join(F.broadcast(first), "cell").select("anchor", "label", "mean", "n", run.alias("run"))


def assign_auto(sections: DataFrame, clusters: DataFrame) -> DataFrame:
    """(section_key, community_id): members to their cluster; sections without a vector to the
    largest cluster (ties: smallest id)."""
    sizes = clusters.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.min(F.struct((-F.col("n")).alias("n"), "community_id")).alias("m")).select(F.col("m.community_id").alias("fallback"))
    rows = sections.select(F.col("node_key").alias("section_key")).distinct().join(clusters.select("section_key", "community_id"), "section_key", "left")
    return rows.join(F.broadcast(largest)).select("section_key", F.coalesce("community_id", "fallback").alias("community_id")).filter("community_id IS NOT NULL")


def community_members(community_sections: DataFrame, sections: DataFrame, files: DataFrame) -> DataFrame:
    rows = community_sections.join(sections.withColumnRenamed("node_key", "section_key"), "section_key").join(files.select("file_id", "path", "title"), "file_id")
    return rows.select("community_id", "section_key", "file_id", "path", "title", "heading_path", "text")


def prune_empty_auto(communities: DataFrame, community_sections: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Automatic communities without members go, with their reports."""
    empty = communities.filter("seed_source = 'auto'").join(community_sections.select("community_id"), "community_id", "left_anti").select("community_id")
    return communities.join(empty, "community_id", "left_anti"), reports.join(empty, "community_id", "left_anti")


def membership_diff(before: DataFrame, after: DataFrame, reports: DataFrame) -> DataFrame:
    """(community_id, reason): communities of ``after`` whose member set changed, or that have no
    report. Sets are compared by an order-free sum of hashes and a count, not gathered."""
    mark = lambda df, name: df.distinct().groupBy("community_id").agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("section_key")).alias("x"), F.sum(F.xxhash64(F.lit("salt"), "section_key") % 1_000_000_007).alias("s")).alias(name))
    both = mark(after, "new").join(mark(before, "old"), "community_id", "left")
    both = both.join(reports.select("community_id", F.lit(True).alias("told")).distinct(), "community_id", "left")
    reason = F.when(F.col("old").isNull() | (F.col("old") != F.col("new")), "changed").when(F.col("told").isNull(), "no report")
    return both.select("community_id", reason.alias("reason")).filter("reason IS NOT NULL")


def context_pack(sections: DataFrame, group_col: str, cap_tokens: int = 3000) -> DataFrame:
    """(group, context, tokens, n_sections): texts in key order until the cap would be passed."""
    rows = sections.withColumn("_t", trimmed(F.coalesce("text", F.lit("")))).filter("_t <> ''").withColumn("_n", estimate_tokens(F.col("_t")))
    kept = within_budget(rows, group_col, "node_key", "_n", cap_tokens)
    block = F.concat(F.lit("### "), F.coalesce(F.nullif("heading_path", F.lit("")), F.col("node_key")), F.lit("\n"), "_t")
    packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_key", block.alias("b")))), lambda x: x["b"]), "\n\n")
    return kept.groupBy(group_col).agg(packed.alias("context"), F.sum("_n").alias("tokens"), F.count(F.lit(1)).alias("n_sections"))


def community_reports(index: dict[str, DataFrame], complete_fn=offline_completion, cap_tokens: int = 3000, only: DataFrame | None = None, model: str = "offline") -> DataFrame:
    """COMMUNITY_REPORTS rows: one completion a packed community; failures keep an empty report."""
    members = community_members(index["community_sections"], index["sections"], index["files"]).withColumnRenamed("section_key", "node_key")
    if only is not None:
        members = members.join(only.select("community_id").distinct(), "community_id", "left_semi")
    packed = context_pack(members, "community_id", cap_tokens).withColumn("prompt", F.col("context"))
    done = run_completions(packed.select("community_id", "tokens", "prompt"), complete_fn)
    return done.select("community_id", F.col("completion").alias("report"), F.lit(model).alias("model"), F.col("tokens").cast("int").alias("tokens"), F.current_timestamp().alias("built_at"))
