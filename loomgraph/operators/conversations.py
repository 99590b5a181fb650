"""Conversation turns: windows, answers, citations, question-answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens


def recent_turns(turns: DataFrame, limit: int = 15) -> DataFrame:
    """The last ``limit`` turns of each conversation."""
    last = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("n", F.row_number().over(last)).filter(F.col("n") <= limit).drop("n")


def _joined(order: str, text: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), sep)


def reconstruct_answer(turns: DataFrame) -> DataFrame:
    """(conv_id, answer): assistant fragments joined in turn order; a fixed text without any."""
    said = turns.filter("role = 'assistant' AND text <> ''").groupBy("conv_id").agg(_joined("turn", F.col("text"), "").alias("answer"))
    return turns.select("conv_id").distinct().join(said, "conv_id", "left").select("conv_id", F.coalesce("answer", F.lit("[The agent produced no answer text.]")).alias("answer"))


def chat_context(results: DataFrame) -> DataFrame:
    """(q_id, context): numbered source blocks of ranked results (q_id, rank, file_path,
    heading_path, line_start, line_end, text)."""
    place = F.concat("file_path", F.when(F.coalesce("heading_path", F.lit("")) != "", F.concat(F.lit(" — "), "heading_path")).otherwise(""))
    n = F.row_number().over(W.partitionBy("q_id").orderBy("rank"))
    rows = results.withColumn("n", n)
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), place, F.lit(" (lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("):\n"), "text")
    return rows.groupBy("q_id").agg(_joined("n", block, "\n\n").alias("context"))


def number_citations(answers: DataFrame) -> DataFrame:
    """(answer_id, source, citation): sources cited as ``[n]`` or ``[[n]]``, numbered by first use."""
    marks = answers.select("answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[?\[(\d+)\]\]?"), 1)).alias("pos", "source"))
    first = marks.withColumn("source", F.expr("try_cast(source AS INT)")).filter("source >= 1").groupBy("answer_id", "source").agg(F.min("pos").alias("pos"))
    return first.select("answer_id", "source", F.row_number().over(W.partitionBy("answer_id").orderBy("pos")).alias("citation"))


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer). With a ``call_id`` column: assistant questions and the
    first later tool reply of the same call; without: each user turn and the next assistant turn.
    Declined (``NO_ANSWER:``) and empty answers are dropped."""
    if "call_id" in turns.columns:
        asked = turns.filter("role = 'assistant' AND call_id IS NOT NULL").select("conv_id", "call_id", "turn", F.col("text").alias("question"))
        replies = turns.filter("role = 'tool' AND call_id IS NOT NULL").select("conv_id", "call_id", F.col("turn").alias("at"), F.col("text").alias("answer"))
        rows = asked.join(replies, ["conv_id", "call_id"]).filter("at > turn").groupBy("conv_id", "turn", "question").agg(F.min_by("answer", "at").alias("answer"))
    else:
        order = W.partitionBy("conv_id").orderBy("turn")
        rows = turns.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(order).alias("next"), F.lead("text").over(order).alias("answer"))
        rows = rows.filter("role = 'user' AND next = 'assistant'").select("conv_id", "turn", "question", "answer")
    return rows.filter((F.col("question") != "") & (F.col("answer") != "") & ~F.col("answer").startswith("NO_ANSWER:"))


def compact_window(turns: DataFrame, budget_tokens: int = 6000) -> DataFrame:
    """Conversations over the budget keep their first turn and the tail from the earlier of the
    last-but-one assistant turn and the last-but-one report (a tool turn that begins ``# ``);
    with fewer than two of either, everything after the first turn."""
    tokens = F.sum(estimate_tokens(F.coalesce("text", F.lit(""))))
    second = lambda c: F.get(F.sort_array(F.collect_list(c), asc=False), F.lit(1))
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    rows = turns.join(first, "conv_id")
    rest = F.col("turn") > F.col("first")
    said = F.when(rest & (F.col("role") == "assistant"), F.col("turn"))
    told = F.when(rest & (F.col("role") == "tool") & F.col("text").startswith("# "), F.col("turn"))
    facts = rows.groupBy("conv_id", "first").agg(tokens.alias("tokens"), second(said).alias("a"), second(told).alias("b"))
    start = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least("a", "b")).otherwise(F.col("first"))
    facts = facts.select("conv_id", "first", "tokens", start.alias("start"))
    out = turns.join(facts, "conv_id")
    return out.filter((F.col("tokens") <= budget_tokens) | (F.col("turn") == F.col("first")) | (F.col("turn") >= F.col("start"))).drop("first", "tokens", "start")
