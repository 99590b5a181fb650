"""Tool-call linking against a plain version, and arguments that must not end the job."""

import json
import random

import pytest

from loomgraph.llm import tool_calls

SCHEMA = {"t": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
CALLS = "conv_id long, call_id string, name string, arguments string, after string, depth int, result string, copies string"
RESULTS = "conv_id long, call_id string, content string, name string, position long"


def linked(spark, calls, results):
    calls = spark.createDataFrame([(*c, 5, "clash", "x") for c in calls], CALLS).repartition(3)
    results = spark.createDataFrame([(*r, "clash", 9) for r in results], RESULTS).repartition(2)
    return tool_calls.linked_calls(calls, results, SCHEMA).collect()


def plain(calls, results):
    """The rows by loops: (conv, call, position, depth, linked, error of the links, copies)."""
    low = lambda x: (x is not None, x)  # noqa: E731  nulls first, as in a least struct
    one, copies, out = {}, {}, []
    for conv, call, name, arguments, after in calls:
        if conv is None or call is None:
            out.append([conv, call, 0, False, "no id", 1])
            continue
        row = (name, arguments, after)
        key = conv, call
        copies[key] = copies.get(key, 0) + 1
        if key not in one or tuple(map(low, row)) < tuple(map(low, one[key])):
            one[key] = row
    got = {(r[0], r[1]) for r in results if None not in r[:2]}
    for key in {*one, *got}:
        if key not in one:
            out.append([*key, 0, False, "no call", 0])
            continue
        seen, at, depth = set(), key, 0
        while at in one and one[at][2] is not None and (at[0], one[at][2]) in one and at not in seen:
            seen.add(at)
            at, depth = (at[0], one[at][2]), depth + 1
        after = one[key][2]
        cycle = at in seen
        error = "after: cycle" if cycle else "after: no such call" if after is not None and (key[0], after) not in one else None
        out.append([*key, -1 if cycle else depth, key in got, error, copies[key]])
    out.sort(key=lambda r: (low(r[0]), r[2], low(r[1])))
    first = {}
    return sorted(((r[0], r[1], first.setdefault(r[0], i) * 0 + i - first[r[0]], *r[2:]) for i, r in enumerate(out)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_cycles_and_copies(spark, seed):
    rng = random.Random(seed)
    calls = []
    for conv in (1, 2, 3, 4):
        n = 60 if conv == 1 else 12
        for i in range(n):
            after = rng.choice([None, f"c{rng.randrange(n)}", f"c{max(0, i - 1)}", f"c{i}", f"r{i}", "nowhere"])
            calls += [(conv, f"c{i}", "t", "{}", after)] * rng.choice([1, 1, 1, 2])
    calls += [(7, "a", "t", "{}", "b"), (7, "b", "t", "{}", "a"), (7, "c", "t", "{}", "b"), (7, "c", "t", "{}", None), (None, "n", "t", "{}", None), (8, None, "t", "{}", None)]
    results = [(conv, rng.choice(["c", "r"]) + str(i), f"text {i}") for conv in (1, 2, 3) for i in range(0, 20, 2)] * 2 + [(None, "c1", "x"), (9, "only", None)]
    rows = linked(spark, calls, results)
    got = sorted(((r["conv_id"], r["call_id"], r["position"], r["depth"], r["linked"], r["error"], r["copies"]) for r in rows), key=repr)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in plain(calls, results)]
    assert [g[2] for g in got if g[1] is not None and g[0] is not None] == [w[2] for w in plain(calls, results) if w[1] is not None and w[0] is not None]


def test_a_result_alone_is_no_call_to_wait_for(spark):
    rows = {r["call_id"]: r for r in linked(spark, [(1, "b", "t", "{}", "a")], [(1, "a", "r")])}
    assert (rows["b"]["error"], rows["b"]["valid"], rows["b"]["depth"]) == ("after: no such call", False, 0)
    assert rows["a"]["error"] == "no call"


def test_odd_arguments_are_errors_and_never_end_the_job(spark):
    deep = "[" * 3000 + "]" * 3000
    cases = {
        "surrogate": ('{"q":"\\ud800","n":1}', "$.q: unknown"),
        "key": ('{"\\udfff":1}', "$.\\udfff: unknown"),
        "pair": ('{"\\ud83d\\ude00":1}', "$.😀: unknown"),
        "huge": ('{"n":' + "9" * 400 + "}", None),
        "minus": ('{"n":-' + "9" * 400 + "}", "$.n: out of range"),
        "digits": ('{"n":' + "9" * 5000 + "}", "arguments: not JSON"),
        "float": ('{"n":1e999}', "$.n: not integer"),
        "nan": ('{"n":NaN}', "$.n: not integer"),
        "deep": ('{"n":' + deep * 40 + "}", None),
        "nested": ('{"n":' + "[" * 900 + "]" * 900 + "}", None),
        "deeper": ('{"n":' + "[" * 200_000 + "]" * 200_000 + "}", None),
        "none": (None, "arguments: none"),
        "null": ("null", "arguments: none"),
        "text": ("{bad", "arguments: not JSON"),
        "empty": ("", "arguments: not JSON"),
        "list": ("[1]", "arguments: not an object"),
        "long": ('{"n":1,"s":"' + "x" * 2_000_000 + '"}', "$.s: unknown"),
    }
    rows = {r["call_id"]: r for r in linked(spark, [(1, k, "t", a, None) for k, (a, _) in cases.items()], [])}
    assert len(rows) == len(cases)
    for k, (_, error) in cases.items():
        if k in ("deep", "nested", "deeper"):
            assert rows[k]["error"] in ("arguments: nested too deep", "$.n: not integer", "arguments: not JSON")
        else:
            assert rows[k]["error"] == error, k
    assert json.loads(rows["huge"]["message"])["arguments"]["n"] == int("9" * 400)
    assert json.loads(rows["surrogate"]["message"])["arguments"]["q"] == "\ud800"
    assert json.loads(rows["text"]["message"])["arguments"] == "{bad"
