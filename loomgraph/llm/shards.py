"""Operator 7 - sharding by balanced label propagation.

Documents are linked through groups (here: equal texts; any (node, hub) table will do). Every
document starts in the shard its hash deals it to. Each round is two joins: groups count their
members by shard, then members ask to move to the shard where most of their group lies. What
may move between two shards is bounded: as many rows one way as come back the other way, plus
the room that is left under the quota; who goes is decided by a hash of the document, so a
quota is met without ordering a shard in one task. Groups, moves and counts are summed on the
map side: one group may hold any share of the rows. A group above a quota has no shard to
agree on; its rows are dealt to a run of neighbouring shards from the start and stay there.

The last step makes the law ``rows`` exact: documents sorted by (shard, group, id) are cut into
shards whose counts differ by one at most. A group is split only where a cut falls into it, and
a document's place within its shard is its slot.

Defined results: a null text has size 8, crc32 0, and is linked with the empty text; repeated
rows are separate rows with slots of their own; a null doc_id is placed like any other; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .store import drop_written, joined_by_weight, written

SHARDS = 24


def _share(*parts) -> Column:
    """A hash of the row in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def propagate(members: DataFrame, shards: int = SHARDS, rounds: int = 3, slack: float = 0.02) -> DataFrame:
    """``members`` (node, hub, and what else they carry) with ``shard`` and ``linked`` (has a
    neighbour) after balanced label propagation."""
    total = members.count()
    quota = int(total / shards * (1 + slack)) + 1
    groups = written(members.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    # Fewer than ``shards`` groups exceed a quota. They are laid end to end along the shards once,
    # each row of them by its hash, and do not vote.
    start, run, gone = F.lit(None).cast("double"), F.lit(None).cast("double"), 0
    for r in groups.filter(F.col("n") > quota).orderBy("hub").collect():
        start, run = F.when(F.col("hub") == r["hub"], float(gone)).otherwise(start), F.when(F.col("hub") == r["hub"], float(r["n"])).otherwise(run)
        gone += r["n"]
    spot = F.when(F.col("node").isNull(), F.rand(7)).otherwise(_share("node"))
    own = F.least(F.floor((start + spot * run) * shards / max(total, 1)), F.lit(shards - 1))
    first = F.coalesce(own, F.pmod(F.xxhash64("node", "hub"), F.lit(shards))).cast("int")
    met = joined_by_weight(members, groups.withColumn("members", F.col("n")), ["hub"], "n", "left")
    now = met.withColumns({"linked": F.col("members").isNotNull(), "placed": start.isNotNull(), "shard": first}).drop("members")
    columns = [*members.columns, "linked", "placed"]
    now = written(now.select(*columns, "shard"), "labels")
    for step in range(rounds):
        votes = now.filter("linked AND NOT placed").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        # Ties go by a hash, not by the shard's number: else moves would drift one way.
        top = F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("top")
        best = written(votes.groupBy("hub").agg(F.sum("n").alias("all"), top).select("hub", "all", F.col("top.shard").alias("goal")), "best")
        voters = joined_by_weight(now.filter("linked AND NOT placed"), best, ["hub"], "all").select(*columns, "shard", "goal")
        asked = written(voters.unionByName(now.filter("NOT linked OR placed").withColumn("goal", F.col("shard"))), "asked")
        # At most shards x shards x 2 sums.
        flow = {(r["shard"], r["goal"], r["linked"]): r["n"] for r in asked.groupBy("shard", "goal", "linked").agg(F.count(F.lit(1)).alias("n")).collect()}
        size, alone, out, into = ([0.0] * shards for _ in range(4))
        for (s, g, tied), n in flow.items():
            size[s] += n
            alone[s] += 0 if tied else n
            out[s] += n if g != s else 0
            into[g] += n if g != s else 0
        # A shard takes what leaves it, what its quota has room for, and what its single rows can make way for.
        grant = [min(1.0, (out[g] + max(0.0, quota - size[g]) + alone[g]) / into[g]) if into[g] else 0.0 for g in range(shards)]
        moved = {(s, g): n * grant[g] for (s, g, _), n in flow.items() if s != g}
        after_moves = [size[k] + sum(n for (s, g), n in moved.items() if g == k) - sum(n for (s, g), n in moved.items() if s == k) for k in range(shards)]
        surplus = [max(0.0, x - quota) for x in after_moves]
        leave = [min(1.0, s / n) if n else 0.0 for s, n in zip(surplus, alone, strict=True)]
        lack = [max(0.0, quota - x) for x in after_moves]
        ends, gone = [], 0.0
        for x in lack:
            gone += x
            ends.append(gone / max(1.0, sum(lack)))
        number = lambda values, k: F.element_at(F.array(*[F.lit(float(v)) for v in values]), k + 1)
        chance = F.when(F.col("linked"), number(grant, F.col("goal"))).otherwise(number(leave, F.col("shard")))
        u = _share("node", F.lit(f"to{step}"))
        room = F.least(F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= u)), F.lit(shards - 1)).cast("int")
        target = F.when(F.col("linked"), F.col("goal")).otherwise(room)
        moves = _share("node", F.lit(f"go{step}")) < chance
        after = written(asked.select(*columns, F.when(moves, target).otherwise(F.col("shard")).alias("shard")), "labels")
        drop_written(asked)
        drop_written(best)
        drop_written(now)
        now = after
        if not sum(moved.values()):
            break
    return now


def even_cuts(labelled: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """``labelled`` with ``shard`` and ``slot``: rows in ``order`` are cut into runs whose
    lengths differ by one at most. One range sort; only one count a partition meets the driver."""
    out, total = ranked(labelled, order, "_rank")
    rank = F.col("_rank")
    small, extra = divmod(total, shards)  # the first ``extra`` shards have one row more
    edge = extra * (small + 1)
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - edge) / max(small, 1)))
    out = out.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * small + F.least("shard", F.lit(extra))
    return out.withColumn("slot", (F.col("_rank") - start).cast("long")).drop("_rank")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, hub) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("node"),
        F.xxhash64(text, F.length(text)).alias("hub"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    labelled = propagate(rows, shards, rounds).withColumnRenamed("shard", "label")
    # Single rows lie at both ends of a shard, so that cuts fall between them and not into groups.
    zone = F.when(F.col("linked"), 1).otherwise(F.pmod(F.col("hub"), F.lit(2)) * 2)
    cut = even_cuts(labelled.withColumn("zone", zone), ["label", "zone", "hub", "node"], shards)
    return cut.select(F.col("node").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hub")
