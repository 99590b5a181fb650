"""Evidence ledgers: scores, contradictions, status and triggers, for many runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


UNIT = 10_000  # scores are kept in whole steps of their fourth decimal
RUN = 12  # bits of the position in a task's sorted rows that one merge takes together


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(UNIT), x)).cast("long")


def _then(a: Column, b: Column, fields: list[str]) -> Column:
    """What ``a`` and after it ``b`` do. Each is a stretch of steps: the score after it is the score
    before, shifted and held between two bounds; so is that of the two together. A stretch with a
    delete forgets what was before it."""
    held = lambda x: F.greatest(b["low"], F.least(b["high"], x + b["shift"]))
    both = {
        "deleted": a["deleted"],
        "n": a["n"] + b["n"],
        "low": held(a["low"]),
        "high": held(a["high"]),
        "shift": a["shift"] + b["shift"],
        "evidence": F.concat(a["evidence"], b["evidence"]),
        "contradicts": F.array_union(a["contradicts"], b["contradicts"]),
        "assumption": F.coalesce(a["assumption"], b["assumption"]),
        "created_at": F.when(a["n"] > 0, a["created_at"]).otherwise(b["created_at"]),
    }
    return F.when(b["deleted"], b).otherwise(F.struct(*[both[f].alias(f) for f in fields]))


def fold_ledger(events: DataFrame, confirm: float = 0.8, refute: float = 0.0) -> DataFrame:
    """(run_id, id, score, evidence, contradicts, assumption, created_at, status) from events
    (run_id, id, seq, op add/score/delete, amount, assumption, evidence, contradicts, ts). The
    score is clamped to 0..1 and rounded to 4 places after each step, in ``seq`` order, from 0.5; an
    ``add`` sets it, and an id lives from after its last ``delete``. Steps with the same ``seq`` of an id
    follow in the order of op, amount and the rest. A null or NaN amount
    is 0 (0.5 for ``add``).

    A step is (low, high, shift) in whole ten-thousandths, and so is any stretch of steps, so stretches
    are merged without their steps: rows are ranged by id and order, an id with a third of all
    rows over many tasks, and at most 4,096 stretches meet in one group until the last merge,
    which has one or two a task. Evidence, being a list in the result, is carried in full."""
    adds, dead = F.col("op").eqNullSafe("add"), F.col("op").eqNullSafe("delete")
    told = F.nanvl(F.col("amount").cast("double"), F.lit(None).cast("double"))
    given = F.coalesce(told, F.when(adds, 0.5).otherwise(0.0))
    # a shift of twice the whole range says as much as any larger one
    shift = F.floor(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("amount"))).cast("decimal(28,12)") * UNIT + F.lit("0.5").cast("decimal(2,1)")).cast("long")
    step = events.select("run_id", "id", "seq", "op", given.alias("amount"), "assumption", "evidence", F.col("contradicts").cast("array<string>").alias("contradicts"), "ts")
    order = ["run_id", "id", "seq", "op", "amount", "assumption", "evidence", "contradicts", "ts"]
    rows = step.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    none = F.array().cast("array<string>")
    listed = lambda when, value: F.when(when, value).otherwise(none)
    part = {
        "deleted": dead,
        "n": F.when(dead, 0).otherwise(1).cast("long"),
        "low": F.when(dead, 0).when(adds, _clamped(shift)).otherwise(0).cast("long"),
        "high": F.when(dead, UNIT).when(adds, _clamped(shift)).otherwise(UNIT).cast("long"),
        "shift": F.when(dead | adds, 0).otherwise(shift).cast("long"),
        "evidence": listed(~dead & F.col("evidence").isNotNull(), F.array("evidence")),
        "contradicts": listed(~dead & F.col("contradicts").isNotNull(), F.array_distinct("contradicts")),
        "assumption": F.when(~dead, F.col("assumption")),
        "created_at": F.when(~dead, F.col("ts")),
    }
    fields = list(part)
    start = F.struct(
        F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("low"), F.lit(UNIT).cast("long").alias("high"), F.lit(0).cast("long").alias("shift"),
        none.alias("evidence"), none.alias("contradicts"), F.lit(None).cast("string").alias("assumption"), F.lit(None).cast(events.schema["ts"].dataType).alias("created_at"),
    )
    merged = rows.select("run_id", "id", "at", F.struct(*[c.alias(f) for f, c in part.items()]).alias("part"))
    for bits in (RUN, RUN, None):
        keys = ["run_id", "id"] if bits is None else ["run_id", "id", F.shiftright("at", bits).alias("run")]
        listing = F.array_sort(F.collect_list(F.struct("at", "part")))
        grouped = merged.groupBy(*keys).agg(listing.alias("parts"))
        whole = F.aggregate("parts", start, lambda a, x: _then(a, x["part"], fields)).alias("part")
        merged = grouped.select("run_id", "id", whole) if bits is None else grouped.select("run_id", "id", F.col("run").alias("at"), whole)
    p = lambda f: F.col("part")[f]
    # from 0.5; the bounds of the whole have the last word
    score = (F.greatest(p("low"), F.least(p("high"), p("shift") + UNIT // 2)) / F.lit(float(UNIT))).alias("score")
    out = merged.filter(p("n") > 0).select("run_id", "id", score, *[p(f).alias(f) for f in ("evidence", "contradicts", "assumption", "created_at")])
    status = F.when(F.col("score") >= confirm, "confirmed").when(F.col("score") <= refute, "refuted").otherwise("open")
    return out.withColumn("status", status)


def rank_ledger(ledger: DataFrame, top: int | None = None) -> DataFrame:
    """Rows with ``rank`` in their run: score down, then created, then id."""
    rows = ledger.withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy(F.col("score").desc(), "created_at", "id")))
    return rows.filter(F.col("rank") <= top) if top else rows


def contradicting_pairs(ledger: DataFrame, soft: float = 0.7) -> DataFrame:
    """(run_id, a, b): linked pairs that are both at the soft threshold, the lower id first."""
    high = ledger.filter(F.col("score") >= soft)
    links = high.select("run_id", "id", F.explode("contradicts").alias("other")).filter("id <> other")
    met = links.join(high.select("run_id", F.col("id").alias("other")), ["run_id", "other"])
    return met.select("run_id", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def evaluate_status(ledger: DataFrame, runs: DataFrame, soft: float = 0.7, confirm: float = 0.8, min_coverage: float = 0.6) -> DataFrame:
    """(run_id, status, reason, top_score) for ``runs`` (run_id, coverage, verify_rounds,
    index_available): conflicted, insufficient_evidence, confirmed, low_confidence or
    needs_verification, the first that applies."""
    pairs = contradicting_pairs(ledger, soft).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    tops = ledger.groupBy("run_id").agg(F.max("score").alias("top_score"))
    rows = runs.join(pairs, "run_id", "left").join(tops, "run_id", "left")
    strong, checked = F.col("top_score") >= confirm, F.col("verify_rounds") >= 1
    rules = (
        (F.col("n_pairs") > 0, "conflicted", "contradiction"),
        (~F.col("index_available") & (F.col("verify_rounds") > 0), "insufficient_evidence", "index unavailable"),
        (F.col("coverage") < min_coverage, "insufficient_evidence", "coverage"),
        (F.col("top_score").isNull(), "insufficient_evidence", "no assumptions"),
        (strong & checked, "confirmed", "verified"),
        (~strong & checked, "low_confidence", "verified below threshold"),
        (strong, "needs_verification", "not verified"),
    )
    status, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for when, name, why in rules:
        status, reason = status.when(when, name), reason.when(when, why)
    return rows.select("run_id", status.otherwise("needs_verification").alias("status"), reason.otherwise("below threshold").alias("reason"), "top_score")


def clarification_trigger(status: DataFrame, runs: DataFrame, hot_topics: DataFrame | None = None, new_paths: DataFrame | None = None, defer: bool = False) -> DataFrame:
    """(run_id, action, reason) for ``runs`` (run_id, calls_used, call_budget): conflicted and
    insufficient_evidence are mandatory (the latter unless deferred), a hot topic in a newly
    sampled path is optional, a budget used to 80 % without verification is mandatory."""
    rows = status.join(runs.select("run_id", "calls_used", "call_budget"), "run_id")
    hot = F.lit(False)
    if hot_topics is not None and new_paths is not None:
        topics = hot_topics.select("run_id", F.lower("topic").alias("topic"))
        met = new_paths.select("run_id", F.lower("path").alias("path")).join(topics, "run_id").filter(F.col("path").contains(F.col("topic"))).select("run_id", F.lit(True).alias("hot")).distinct()
        rows = rows.join(met, "run_id", "left")
        hot = F.coalesce("hot", F.lit(False))
    used = F.when(F.col("call_budget") > 0, F.col("calls_used") / F.col("call_budget")).otherwise(1.0)
    lacking = (F.col("status") == "insufficient_evidence") & F.lit(not defer)
    late = (used >= 0.8) & (F.col("status") == "needs_verification")
    action = F.when((F.col("status") == "conflicted") | lacking, "mandatory").when(hot, "optional").when(late, "mandatory").otherwise("none")
    reason = F.when(F.col("status") == "conflicted", "conflicted").when(lacking, "insufficient_evidence").when(hot, "hot_topic").when(late, "budget").otherwise("no_trigger")
    return rows.select("run_id", action.alias("action"), reason.alias("reason"))


def summary_card(runs: DataFrame, ledger: DataFrame, folders: DataFrame, top: int = 5) -> DataFrame:
    """(run_id, card): the status (runs: run_id, status, coverage), leading assumptions and
    folders (run_id, folder, n_files) of each run as one text."""
    lead = rank_ledger(ledger, top)
    line = F.format_string("- [%s] %.2f %s", "status", "score", F.coalesce("assumption", F.col("id")))
    said = lead.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    seen = folders.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("folder", "n_files"))), lambda x: F.concat(F.lit("- "), x["folder"], F.lit(": "), x["n_files"].cast("string"))), "\n").alias("dirs"))
    rows = runs.join(said, "run_id", "left").join(seen, "run_id", "left")
    return rows.select("run_id", F.concat_ws("\n", F.format_string("status: %s (coverage %.2f)", "status", "coverage"), F.lit("assumptions:"), "lines", F.lit("folders:"), "dirs").alias("card"))
