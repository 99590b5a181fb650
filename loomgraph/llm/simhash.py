"""Operator 5 - SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint maps to the bit counts of its 16 four-bit segments. Flipping a bit moves
that vector by one step, so the Manhattan distance of two vectors is a lower bound of the
fingerprints' Hamming distance. Fingerprints at distance 2 or less share a vector at one step
or none from both: the grid range-join puts every distinct fingerprint into the cells of its
own vector and of its at most 32 neighbours and looks at cells that hold more than one. A cell
of two is verified exactly as the pair it is; larger cells are split by the fingerprints one
bit flip away, a group of which holds at most 65 fingerprints by construction. So no cell is
ever expanded into all its pairs, however many near copies lie in it.

Equal fingerprints are one node of the graph before any join, which makes groups of exact
copies cost one row; large groups meet their component by broadcast. Components run on
fingerprints, then map to documents. ``simhash_groups`` does the same over several independent
fingerprints a text.

Defined results: null and word-less texts have fingerprint 0, linked like any other; repeated
rows share their component; a null doc_id keeps its row and takes its group's smallest id;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import condensed, joined_by_weight, written

SEED = 42
CHUNK = 100_000


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hash values as the ``k``-th of several independent hash functions gives them (0: as they are)."""
    if k == 0:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints_of(text: str | None, shingle: int = 3, count: int = 1) -> np.ndarray:
    """Majority bits of the XXH64 hashes of a text's word shingles (0 without a word), and of
    ``count`` - 1 further hash functions of them."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII case and space only
    if not words:
        return np.zeros(count, dtype=np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    sums, n, part = np.zeros((count, 64), dtype=np.int64), 0, []

    def add() -> None:
        nonlocal n
        h = np.array(part, dtype="<u8")
        for k in range(count):
            bits = np.unpackbits(_mixed(h, k).view(np.uint8), bitorder="little").reshape(-1, 64)
            sums[k] += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
        part.clear()

    digest = xxhash.xxh64_intdigest
    for g in grams:
        part.append(digest(g, SEED))
        if len(part) == CHUNK:
            add()
    if part:
        add()
    return np.packbits(2 * sums > n, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    return int(fingerprints_of(text, shingle)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, count: int = 1) -> DataFrame:
    """(doc_id, fp), or with a ``count`` over one (doc_id, fps): one narrow pass; a fingerprint's
    64 bits are a signed long."""
    name, kind = ("fp", "long") if count == 1 else ("fps", "array<long>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.array([fingerprints_of(t, shingle, count) for t in b["text"]], dtype=np.uint64).reshape(len(b), count).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), name: found[:, 0] if count == 1 else list(found)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"doc_id long, {name} {kind}")


def popcount_vector(fp: Column) -> Column:
    """The 16 segment bit counts, each in a nibble of one long."""
    ones = F.lit(0x1111111111111111)
    return fp.bitwiseAND(ones) + sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in (2, 3)), F.shiftrightunsigned(fp, 1).bitwiseAND(ones))


def _cells(key: Column) -> Column:
    """The vector itself (step 0) and its neighbours: +1 in segment s is step s + 1, -1 is -(s + 1)."""
    out = [F.struct(key.alias("cell"), F.lit(0).cast("byte").alias("step"))]
    for s in range(16):
        one = F.shiftleft(F.lit(1).cast("long"), 4 * s)
        at = F.shiftrightunsigned(key, 4 * s).bitwiseAND(F.lit(15))
        out.append(F.when(at < 4, F.struct((key + one).alias("cell"), F.lit(s + 1).cast("byte").alias("step"))))
        out.append(F.when(at > 0, F.struct((key - one).alias("cell"), F.lit(-s - 1).cast("byte").alias("step"))))
    return F.filter(F.array(*out), lambda c: c.isNotNull())


def _bit(step: Column) -> Column:
    """A step as one of 33 bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (step + F.lit(16)).cast("int"))


def _ways_back(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(cell, key, step): the vectors from which members came to ``cells``, by the ``steps`` that
    they took. They lie one step away at most, so the grid need not be dealt again, and there are
    no more of them than members."""
    back = F.filter(_cells(F.col("cell")), lambda c: F.col("steps").bitwiseAND(_bit(-c["step"])) != 0)
    return cells.select(*by, "cell", F.explode(back).alias("c")).select(*by, "cell", F.col("c.cell").alias("key"), (-F.col("c.step")).alias("step"))


def links(prints: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fp`` values at Hamming distance 2 or less; with
    columns ``by`` only fingerprints that agree in them."""
    keyed = prints.select(*by, "fp").distinct().withColumn("key", popcount_vector(F.col("fp")))
    grid = keyed.select(*by, "fp", F.explode(_cells(F.col("key"))).alias("c")).select(*by, "fp", "c.cell", "c.step")
    cells = written(grid.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_or(_bit(F.col("step"))).alias("steps")).filter("n > 1"), "cells")
    near = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= 2
    pairs = cells.filter(F.col("n") == 2).filter(near).select(*by, F.col("lo").alias("a"), F.col("hi").alias("b"))
    members = keyed.join(_ways_back(cells.filter("n > 2"), by), [*by, "key"])
    # In a full cell: the fingerprints one flip away whose vector is the cell (its own at step 0).
    bits = [F.expr(f"shiftleft(1L, cast((abs(step) - 1) * 4 + {k} as int))") for k in range(4)]
    flips = [F.when((F.col("fp").bitwiseAND(b) != 0) == (F.col("step") < 0), F.col("fp").bitwiseXOR(b)) for b in bits]
    hubs = F.when(F.col("step") == 0, F.array("fp")).otherwise(F.filter(F.array(*flips), lambda x: x.isNotNull()))
    hub = members.select(*by, "fp", F.explode(hubs).alias("hub")).groupBy(*by, "hub").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = hub.select(*by, F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    return condensed("components", lambda: _components_of(docs, id_col, text_col, shingle))


def _components_of(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    by_fp = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "by-fp")
    roots = components(links(prints))
    rooted = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    by_fp = by_fp.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n")
    return joined_by_weight(prints, written(by_fp, "of-fp"), ["fp"], "n").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, count: int = 4) -> DataFrame:
    """(doc_id, component_id) by ``count`` independent fingerprints a text: two rows are linked if
    any one of these differs in 2 or fewer bits, so a near copy that one hash function misses has
    ``count`` - 1 further chances, while unrelated texts stay as far apart as with one. Ids must
    be unique and not null. Rows with equal fingerprints are one node; a fingerprint that several
    nodes share links each to the least of them, never all pairs."""
    return condensed("groups", lambda: _groups_of(docs, id_col, text_col, shingle, count))


def _groups_of(docs: DataFrame, id_col: str, text_col: str, shingle: int, count: int) -> DataFrame:
    prints = written(fingerprints(docs, id_col, text_col, shingle, count), "prints")
    nodes = written(prints.groupBy("fps").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    each = written(nodes.select("node", F.posexplode("fps").alias("k", "fp")), "each")
    least = written(each.groupBy("k", "fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "least")
    shared = joined_by_weight(each, least.filter("n > 1"), ["k", "fp"], "n").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(least, ("k",))
    for side in ("a", "b"):
        near = near.join(least.select("k", F.col("fp").alias(side), F.col("first").alias(f"of_{side}")), ["k", side])
    roots = components(shared.unionByName(near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
    rooted = nodes.join(roots, "node", "left").select("fps", F.coalesce("root", "node").alias("component_id"), "n")
    return joined_by_weight(prints, written(rooted, "of-fps"), ["fps"], "n").select("doc_id", "component_id")
