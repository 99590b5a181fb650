"""Operator 11 - Merkle manifest of a dataset by sibling-shift self-joins.

A leaf is the sha256 of a row's fields, each as its byte count and value. The rows of a group
(here a language) stand in the order of their id; every level equijoins its nodes with themselves
on a computed sibling index (index XOR 1 for a binary tree, an offset within the run for each
further slot otherwise), and the rows at slot zero then emit the parents. The groups' roots are
the leaves of one more tree. Going down again, each node's siblings are put before its parent's
path, so a row ends with the siblings of all its levels: its proof.

Positions come from one range sort and a count a partition; a hot group is thus spread over many
partitions like any other rows, and joins are on (group, index), which no two nodes share. All
levels together hold fan_out / (fan_out - 1) times the rows, and each is written once.

Defined results: fields may be null; a null id sorts first, rows with one id are ordered by their
leaf, equal rows by any order, as it cannot be seen; a null group is a group of its own and comes
first; a group of one row has its leaf as root; an empty table gives no row. Texts may have any
length. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .store import joined_by_weight, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 6  # of the way down that are chained before a table is written


def framed(value: Column) -> Column:
    """A field as its UTF-8 byte count, a colon and its value, or a dash: no two lists of fields
    run together to the same string."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, fields)), 256)


def _sided(nodes: DataFrame, fan_out: int) -> DataFrame:
    """Each node with the nodes before it (``left``) and after it (``right``) in its run, joined
    to strings: one equijoin with shifted indices for each other slot."""
    slot = F.col("at") % fan_out
    out = nodes
    for step in range(1, fan_out):
        shifted = F.col("at").bitwiseXOR(F.lit(1)) if fan_out == 2 else F.col("at") - slot + (slot + fan_out - step) % fan_out
        others = nodes.filter("size > 1").select("grp", shifted.alias("at"), F.col("node").alias(f"_s{step}"))
        out = out.join(others, ["grp", "at"], "left")
    at_slot = lambda s, places: F.when(slot == s, F.concat(F.lit(""), *[F.coalesce(f"_s{(t - s) % fan_out}", F.lit("")) for t in places]))
    left = F.coalesce(*[at_slot(s, range(s)) for s in range(fan_out)])
    right = F.coalesce(*[at_slot(s, range(s + 1, fan_out)) for s in range(fan_out)])
    return out.withColumns({"left": left, "right": right}).drop(*[f"_s{k}" for k in range(1, fan_out)])


def levels(nodes: DataFrame, fan_out: int) -> list[DataFrame]:
    """The levels of all groups' trees, from ``nodes`` (grp, at: index from 0, size: nodes of the
    group, node) up to the roots; further columns stay on the lowest level."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    found, now = [], nodes
    while True:
        found.append(written(_sided(now, fan_out), f"level-{len(found)}"))
        if most <= 1:
            return found
        run = found[-1].filter((F.col("size") > 1) & (F.col("at") % fan_out == 0))
        now = run.select("grp", F.expr(f"at div {fan_out}").alias("at"), F.expr(f"(size + {fan_out - 1}) div {fan_out}").alias("size"), F.sha2(F.concat("node", "right"), 256).alias("node"))
        most = -(-most // fan_out)


def endings(nodes: DataFrame, fan_out: int) -> list[int]:
    """The levels on which some group is down to one node: at most one a doubling of the rows."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    bounds = [fan_out**k for k in range(64) if fan_out**k < max(most, 2) * fan_out]
    level = F.coalesce(*[F.when(F.col("size") <= n, k) for k, n in enumerate(bounds)])
    return sorted(r[0] for r in nodes.select(level.alias("k")).distinct().collect())


def roots(found: list[DataFrame], ends: list[int]) -> DataFrame:
    """(grp, root) of each group, from the level on which it is alone."""
    alone = [found[k].filter("size = 1").select("grp", F.col("node").alias("root")) for k in ends or [0]]
    return reduce(DataFrame.unionByName, alone)


def traced(found: list[DataFrame], ends: list[int], above: DataFrame | None, fan_out: int) -> DataFrame:
    """The lowest level with ``path``: (left, right) siblings level by level up to the root, then
    the path of ``above`` (grp, path and columns to hand down), whose rows the roots are."""
    kind = "array<struct<left:binary,right:binary>>"
    kept = [] if above is None else [c for c in above.columns if c not in ("grp", "path")]
    down: DataFrame | None = None
    for k in range(len(found) - 1, -1, -1):
        level = found[k].drop("size", "node") if k else found[k]
        one: DataFrame | None = None
        if k in ends or down is None:
            one = found[k].filter("size = 1").select(*level.columns)
            one = one.withColumn("path", F.array().cast(kind)) if above is None else one.join(above, "grp")
        if down is not None:
            many = found[k].filter("size > 1").select(*level.columns, F.expr(f"at div {fan_out}").alias("_up"))
            up = down.select("grp", F.col("at").alias("_up"), F.col("path").alias("_path"), *kept)
            step = F.array(F.struct(F.unhex("left").alias("left"), F.unhex("right").alias("right")))
            many = many.join(up, ["grp", "_up"]).withColumn("path", F.concat(step, "_path")).drop("_up", "_path")
            one = many if one is None else many.unionByName(one)
        down = one if not k else one.select("grp", "at", "path", *kept)
        if k and k % LEVELS == 0:
            down = written(down, f"paths-{k}")
    return down


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), h, F.lower(F.hex(s["right"]))), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings in the order of the path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(F.lower(F.hex(s["left"])), F.lower(F.hex(s["right"])))), ""), 256)


@dataclass
class Manifest:
    """``rows``: carried columns, leaf, subroot, root, path; ``groups``: (key, subroot, n);
    ``root``: None for an empty table."""

    rows: DataFrame
    groups: DataFrame
    root: str | None


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, fan_out: int = 2, carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs`` with a proof for each row. ``carried`` are named expressions on
    ``docs`` that the rows keep; only these, the leaf and the order travel, never a text."""
    extra = {f"x_{name}": c for name, c in (carried or {}).items()}
    group = F.col(group_col).cast("string")
    key = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group))  # '-' comes before '='
    leaves = docs.select(key.alias("key"), F.col(id_col).alias("id"), leaf_hash([F.col(c) for c in fields]).alias("node"), *[c.alias(n) for n, c in extra.items()])
    placed, _ = ranked(leaves, ["key", "id", "node"], "rank")
    counted = placed.groupBy("key").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size")).withColumn("n", F.col("size"))
    groups, n_groups = ranked(counted, ["key"], "grp")
    nodes = joined_by_weight(placed, groups, ["key"], "n").select("grp", (F.col("rank") - F.col("first")).alias("at"), "size", "node", "id", *extra)
    nodes = written(nodes, "leaves")
    found, ends = levels(nodes, fan_out), endings(groups, fan_out)
    top = roots(found, ends)
    under = written(top.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("at"), F.lit(n_groups).cast("long").alias("size"), F.col("root").alias("node")), "subroots")
    upper, last = levels(under, fan_out), endings(under, fan_out)
    root = next((r["root"] for r in roots(upper, last).collect()), None)
    above = traced(upper, last, None, fan_out).select(F.col("at").alias("grp"), "path", F.col("node").alias("subroot"))
    rows = traced(found, ends, written(above, "above"), fan_out)
    own = rows.select(*[F.col(n).alias(n[2:]) for n in extra], F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "path")
    named = groups.select("grp", F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).alias("key"), F.col("size").alias("n")).join(top, "grp")
    return Manifest(own, named.select("key", F.col("root").alias("subroot"), "n"), root)
