"""Operator 10 - chat formatting with linked tool calls.

``calls`` (conv_id, call_id, name, arguments as JSON text, after: the call it needs or null) are
hash-joined with ``results`` (conv_id, call_id, content) on the pair of ids, so one huge
conversation is spread over all tasks. Depths of the dependency forest come from pointer
doubling: each round a call looks past its pointer's pointer, so a chain of n calls takes log2 n
joins and no conversation is ever gathered. A topological order is (depth, call_id); its
positions come from one range sort. Arguments are checked against the tool's JSON schema
(type, required, properties, additionalProperties, enum, minimum, maximum, minLength, maxLength,
items), and every message is written as canonical JSON: keys sorted, no blanks, no escapes but
the needed ones, whole floats as integers.

Defined results: a call without a result is kept with ``linked`` false and a null result; a
result without a call is kept with name null and error ``no call``; of several calls (results)
of one id the least text holds and ``copies`` tells how many there were; ``after`` that names no
call, the call itself or a cycle is an error and counts as depth 0 (the cycle's calls: -1);
arguments that are null, no JSON, nested too deep or no object are errors; integers of any size
are integers; half a surrogate pair is written as its escape; null ids are rows of their own
(never joined); arguments and results may have any length; empty tables give an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .store import joined_by_weight, written

LONE = re.compile("[\ud800-\udfff]")
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def schema_error(value: Any, schema: dict, at: str = "$") -> str | None:
    """The first way in which ``value`` breaks ``schema``, in a fixed order; None if it fits."""
    kind = schema.get("type")
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if kind == "integer" and not (number and (isinstance(value, int) or value.is_integer())) or kind == "number" and not number:
        return f"{at}: not {kind}"
    if kind in TYPES and not isinstance(value, TYPES[kind]):
        return f"{at}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if number and not (schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf)):
        return f"{at}: out of range"
    if isinstance(value, str) and not (schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf)):
        return f"{at}: length"
    if isinstance(value, list) and "items" in schema:
        return next((e for i, x in enumerate(value) if (e := schema_error(x, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if missing := [k for k in schema.get("required", []) if k not in value]:
            return f"{at}.{missing[0]}: missing"
        if schema.get("additionalProperties", True) is False and (more := sorted(set(value) - set(known))):
            return f"{at}.{more[0]}: unknown"
        return next((e for k in sorted(known) if k in value and (e := schema_error(value[k], known[k], f"{at}.{k}"))), None)
    return None


def canonical(value: Any) -> str:
    def plain(x: Any) -> Any:
        if isinstance(x, float):
            return int(x) if math.isfinite(x) and x.is_integer() and abs(x) < 2**53 else x if math.isfinite(x) else None
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return escaped(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def escaped(text: str) -> str:
    """``text`` with halves of surrogate pairs as escapes, as no UTF-8 text can hold them."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def message(call_id: str | None, name: str | None, arguments: str | None, result: str | None, schema: dict | None) -> tuple[str, str | None]:
    """(canonical JSON of the linked call, error or None)."""
    parsed, raw = None, False
    try:
        parsed = json.loads(arguments) if arguments is not None else None
        error = "arguments: none" if parsed is None else "arguments: not an object" if not isinstance(parsed, dict) else None
    except ValueError:
        error, raw = "arguments: not JSON", True
    except RecursionError:
        error, raw = "arguments: nested too deep", True
    if name is None:
        error = "no call"
    elif schema is None:
        error = "unknown tool"
    elif error is None:
        error = schema_error(parsed, schema)
    body = {"type": "tool_call", "id": call_id, "name": name, "arguments": arguments if raw else parsed, "result": result}
    try:
        text = canonical(body)
    except RecursionError:
        text, error = canonical(body | {"arguments": arguments}), error or "arguments: nested too deep"
    return text, error and escaped(error)


def depths(calls: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(conv_id, call_id, depth): the number of calls a call waits for along its ``after``
    pointers; -1 on or behind a cycle. ``calls`` has one row an id pair."""
    ids = calls.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("there"))
    known = calls.select("conv_id", "call_id", F.col("after").alias("to")).join(ids, ["conv_id", "to"], "left")
    start = F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")
    now = written(known.select("conv_id", "call_id", F.when(F.col("there"), F.col("to")).alias("to"), start), "depths")
    left, rounds = now.filter("to IS NOT NULL").count(), 0
    limit = math.ceil(math.log2(left + 1)) + 1  # a chain no longer than all open calls ends by then
    while left and rounds < min(max_rounds, limit):
        jump = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        now = written(now.join(jump, ["conv_id", "to"], "left").select("conv_id", "call_id", F.when(F.col("to").isNotNull(), F.col("next")).alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
        left, rounds = now.filter("to IS NOT NULL").count(), rounds + 1
    return now.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("depth")).otherwise(F.lit(-1)).alias("depth"))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, position, depth, call_id, name, linked, valid, error, copies, message)."""
    key = ["conv_id", "call_id"]
    real = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    picked = F.min(F.struct("name", "arguments", "after")).alias("c")
    one = calls.filter(real).groupBy(*key).agg(picked, F.count(F.lit(1)).alias("copies")).select(*key, "c.*", "copies")
    one = written(one, "calls")
    got = results.filter(real).groupBy(*key).agg(F.min("content").alias("result"), F.lit(True).alias("answered"))
    lost = calls.filter(~real).select(*key, "name", "arguments", F.lit(None).cast("string").alias("after"), F.lit(1).cast("long").alias("copies"), F.lit(None).cast("string").alias("result"), F.lit(False).alias("linked"), F.lit(0).cast("long").alias("depth"), F.lit("no id").alias("trouble"))
    rows = one.withColumn("called", F.lit(True)).join(got, key, "full").join(depths(one), key, "left")
    dangling = one.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("found"))
    rows = rows.join(dangling, ["conv_id", "after"], "left")
    trouble = F.when(F.col("depth") < 0, "after: cycle").when(F.col("after").isNotNull() & F.col("found").isNull(), "after: no such call")
    rows = rows.select(*key, "name", "arguments", "after", F.coalesce("copies", F.lit(0)).alias("copies"), "result", F.coalesce(F.col("called") & F.col("answered"), F.lit(False)).alias("linked"), F.coalesce("depth", F.lit(0)).alias("depth"), trouble.alias("trouble"))
    rows = rows.unionByName(lost)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean = lambda x: None if x is None or x != x else x
        for b in batches:
            found = [message(clean(i), clean(n), clean(a), clean(r), schemas.get(clean(n) or "")) for i, n, a, r in zip(b["call_id"], b["name"], b["arguments"], b["result"], strict=True)]
            error = [clean(t) or e for t, (_, e) in zip(b["trouble"], found, strict=True)]
            yield pd.DataFrame({"conv_id": b["conv_id"].astype("Int64"), "call_id": b["call_id"], "depth": b["depth"], "name": b["name"], "linked": b["linked"], "copies": b["copies"], "error": error, "message": [m for m, _ in found]})

    shaped = rows.select("conv_id", "call_id", "name", "arguments", "result", "trouble", "linked", "depth", "copies").mapInPandas(run, "conv_id long, call_id string, depth long, name string, linked boolean, copies long, error string, message string")
    placed, _ = ranked(shaped, ["conv_id", "depth", "call_id"], "_rank")
    first = written(placed.groupBy("conv_id").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n")), "first")
    alone = first.filter("conv_id IS NULL").select(F.min("_first")).first()[0]  # null ids: one row at most
    out = joined_by_weight(placed.filter("conv_id IS NOT NULL"), first.filter("conv_id IS NOT NULL"), ["conv_id"], "_n")
    out = out.unionByName(placed.filter("conv_id IS NULL").withColumn("_first", F.lit(alone).cast("long")))
    return out.select("conv_id", (F.col("_rank") - F.col("_first")).alias("position"), "depth", "call_id", "name", "linked", F.col("error").isNull().alias("valid"), "error", "copies", "message")


#: The tools that ``calls_of_turns`` uses.
SCHEMAS = {
    "search": {
        "type": "object",
        "required": ["query", "limit"],
        "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 20}, "language": {"type": "string", "enum": ["en", "other"]}},
    },
    "recall": {"type": "object", "required": ["topic"], "properties": {"topic": {"type": "string", "minLength": 8}, "weight": {"type": "number", "minimum": 0}}},
}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from a table of plain turns (conv_id, turn, role, text): each user turn
    calls a tool about its text and needs the call before it within its four exchanges, each
    assistant turn is the result of the turn before it. Repeated first turns, missing replies
    and replies out of place make real unlinked, repeated and dangling cases."""
    text = F.coalesce("text", F.lit(""))
    call_id = lambda t: F.concat_ws("-", F.lit("call"), F.col("conv_id"), F.lpad(t.cast("string"), 9, "0"))
    words = F.size(F.split(text, r"\s+"))
    search = F.to_json(F.struct(text.alias("query"), (words % 23).alias("limit"), F.when(text.rlike(r"^[\x00-\x7F]*$"), "en").otherwise("other").alias("language")))
    recall = F.to_json(F.struct((words / 7).alias("weight"), F.substring_index(text, ".", 1).alias("topic")))
    use = F.when(F.length(text) % 3 == 0, "recall").otherwise("search")
    calls = turns.filter("role = 'user'").select("conv_id", call_id(F.col("turn")).alias("call_id"), use.alias("name"), F.when(F.length(text) % 3 == 0, recall).otherwise(search).alias("arguments"), F.when(F.col("turn") % 8 >= 2, call_id(F.col("turn") - 2)).alias("after"))
    results = turns.filter("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
