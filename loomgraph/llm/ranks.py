"""Positions in a sorted table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def ranked(df: DataFrame, order: list[str], rank_col: str) -> tuple[DataFrame, int]:
    """``df`` with its row number from 0 in ``order``, and the number of rows: one range sort,
    written once (so that numbers and rows cannot drift apart), and one count a partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, gone = [0] * (max(counts, default=0) + 1), 0
    for p in sorted(counts):
        first[p], gone = gone, gone + counts[p]
    base = F.element_at(F.array(*[F.lit(n).cast("long") for n in first]), (part + 1).cast("int"))
    return placed.withColumn(rank_col, base + row).drop("_at"), gone
