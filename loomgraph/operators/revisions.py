"""Checks and edits over pairs of document versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trimmed, word_count, word_tokens

# Spans that an edit must keep, in the order in which they are checked.
PROTECTED = (
    ("code_fence", r"(?s)```.*?```"),
    ("inline_code", r"`[^`\n]+`"),
    ("image_embed", r"!\[\[[^\]]+\]\]"),
    ("wikilink", r"\[\[[^\]]+\]\]"),
    ("url", "https?://[^\\s()<>\"']+"),
    ("table_row", r"(?m)^\|.+\|.+\|"),
)
HEADER = r"(?m)^(#+ .+)$"
OPS = ("join_lines", "insert_header", "remove_span", "collapse_blanks", "insert_flag")
SPAN_KINDS = ("tag", "properties_block")
OP_SCHEMA = "doc_id string, seq int, op string, kind string, text string, reason string, start int, end int, before_line int"


def _pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, old, new) of the documents in both versions."""
    return before.select("doc_id", F.coalesce("content", F.lit("")).alias("old")).join(after.select("doc_id", F.coalesce("content", F.lit("")).alias("new")), "doc_id")


def words_conserved(before: DataFrame, after: DataFrame, sanctioned: DataFrame | None = None) -> DataFrame:
    """(doc_id, ok, lost): words of the old version that the new one lacks, but for those of the
    sanctioned removals (doc_id, text)."""
    rows = _pairs(before, after)
    lost = F.array_except(F.array_distinct(word_tokens(F.col("old"))), word_tokens(F.col("new")))
    if sanctioned is not None:
        rows = rows.join(sanctioned.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("free")), "doc_id", "left")
        lost = F.array_except(lost, word_tokens(F.coalesce("free", F.lit(""))))
    rows = rows.select("doc_id", F.sort_array(lost).alias("lost"))
    return rows.select("doc_id", (F.size("lost") == 0).alias("ok"), "lost")


def headers_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, ok, missing): the old headers must be an ordered subsequence of the new ones; the
    first that is not is named. A fold over the old headers with the place reached."""
    rows = _pairs(before, after).select("doc_id", F.regexp_extract_all("old", F.lit(HEADER), 1).alias("a"), F.regexp_extract_all("new", F.lit(HEADER), 1).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("missing"))

    def step(s, h):
        place = F.array_position(F.slice("b", s["at"] + 1, F.greatest(F.size("b") - s["at"], F.lit(0))), h).cast("int")
        return F.when(s["missing"].isNotNull(), s).when(place == 0, F.struct(s["at"].alias("at"), h.alias("missing"))).otherwise(F.struct((s["at"] + place).alias("at"), F.lit(None).cast("string").alias("missing")))

    missing = F.aggregate("a", start, step, lambda s: s["missing"])
    return rows.select("doc_id", missing.isNull().alias("ok"), missing.alias("missing"))


def protected_spans(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, ok, kind, lost): the first kind of protected span of which some are gone, and up
    to three of them in order."""
    rows = _pairs(before, after)
    gone = [F.sort_array(F.array_except(F.array_distinct(F.regexp_extract_all("old", F.lit(p), 0)), F.regexp_extract_all("new", F.lit(p), 0))) for _, p in PROTECTED]
    rows = rows.select("doc_id", *[g.alias(k) for (k, _), g in zip(PROTECTED, gone, strict=True)])
    first = F.coalesce(*[F.when(F.size(k) > 0, F.struct(F.lit(k).alias("kind"), F.slice(k, 1, 3).alias("lost"))) for k, _ in PROTECTED])
    return rows.select("doc_id", first.alias("f")).select("doc_id", F.col("f").isNull().alias("ok"), F.col("f.kind").alias("kind"), F.coalesce("f.lost", F.array().cast("array<string>")).alias("lost"))


def join_punctuation(ops: DataFrame, docs_after: DataFrame) -> DataFrame:
    """(doc_id, seq, ok): lines that a join op names must end with a full stop once joined."""
    rows = ops.filter("op = 'join_lines'").join(docs_after.select("doc_id", F.split("content", "\n").alias("all")), "doc_id")
    part = F.slice("all", F.greatest("start", F.lit(1)), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0)))
    joined = F.array_join(F.transform(part, trimmed), " ")
    return rows.select("doc_id", "seq", trimmed(joined).endswith(".").alias("ok"))


def validate_ops(docs: DataFrame, ops: DataFrame) -> DataFrame:
    """``ops`` plus ``error``: the reason why an op is rejected, null if it is valid."""
    sized = ops.join(docs.select("doc_id", F.size(F.split("content", "\n")).alias("max_line")), "doc_id")
    bad = lambda c: F.col(c).isNotNull() & ((F.col(c) < 1) | (F.col(c) > F.col("max_line") + 10))
    told = lambda c: F.concat(F.lit(f"INVALID_ANCHOR: {c}="), F.col(c), F.lit(" (max_line="), F.col("max_line"), F.lit(")"))
    error = F.when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), F.concat(F.lit("UNKNOWN_OP: "), F.coalesce("op", F.lit("")))).when(bad("start"), told("start")).when(bad("end"), told("end")).when(bad("before_line"), told("before_line"))
    error = error.when(F.col("start") > F.col("end"), F.concat(F.lit("INVALID_RANGE: start="), F.col("start"), F.lit(" > end="), F.col("end")))
    error = error.when((F.col("op") == "remove_span") & ~F.coalesce(F.col("kind").isin(*SPAN_KINDS), F.lit(False)), F.concat(F.lit("INVALID_KIND: "), F.coalesce("kind", F.lit("")), F.lit(f" (expected {', '.join(SPAN_KINDS)})")))
    return sized.withColumn("error", error)


def _edited(lines: list[str], ops: list[dict]) -> list[str]:
    """Valid ops applied in order; line numbers are those of the original text."""
    shift = 0
    for o in ops:
        at = [None if pd.isna(o[c]) else int(o[c]) - 1 + shift for c in ("start", "end", "before_line")]
        s, e, b = at
        if o["op"] == "join_lines":
            lines[s : e + 1] = [" ".join(x.strip() for x in lines[s : e + 1])]
            shift -= e - s
        elif o["op"] in ("insert_header", "insert_flag"):
            new = (o["text"] or "") if o["op"] == "insert_header" else f"<!-- review: {o['reason'] or 'flag'} -->"
            lines[b:b] = [new]
            shift += 1
        elif o["op"] == "remove_span":
            del lines[s : e + 1]
            shift -= e - s + 1
        else:
            part, blanks = [], 0
            for x in lines[s : e + 1]:
                blanks += not x.strip()
                if x.strip() or blanks == 1:
                    part.append(x if x.strip() else "")
            if blanks > 1:
                lines[s : e + 1] = part
    return lines


def apply_edits(docs: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edited docs with doc_id, content, n_applied; ops with their ``error``). All ops of a
    document are checked against its original lines; valid ones are applied in ``seq`` order."""
    checked = validate_ops(docs, ops)
    fields = ("seq", "op", "text", "reason", "start", "end", "before_line")
    lists = checked.filter("error IS NULL").groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("ops"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            valid = [[] if o is None else sorted(o, key=lambda x: x["seq"]) for o in b["ops"]]
            done = ["\n".join(_edited(c.split("\n"), o)) for c, o in zip(b["content"], valid, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": done, "n_applied": [len(o) for o in valid]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    edited = docs.select("doc_id", "content").join(lists, "doc_id", "left").mapInPandas(run, f"doc_id {kind}, content string, n_applied int")
    return edited, checked


def receipts(docs_before: DataFrame, docs_after: DataFrame, ops: DataFrame) -> DataFrame:
    """(doc_id, hash_before, hash_after, ops_applied, ops_rejected, diff_stat, checks ok)."""
    checked = validate_ops(docs_before, ops)
    counts = checked.groupBy("doc_id").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("ops_applied"), F.count("error").alias("ops_rejected"))
    by_kind = checked.filter("error IS NULL").groupBy("doc_id", "op").agg(F.count(F.lit(1)).alias("n"))
    stat = by_kind.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("op", "n")))).alias("diff_stat"))
    short = lambda c: F.substring(F.sha1(c), 1, 12)
    free = checked.filter("op = 'remove_span' AND kind IN ('tag', 'properties_block')").select("doc_id", F.col("kind").alias("text"))
    rows = _pairs(docs_before, docs_after).select("doc_id", short("old").alias("hash_before"), short("new").alias("hash_after"))
    for name, checks in (("words_ok", words_conserved(docs_before, docs_after, free)), ("headers_ok", headers_preserved(docs_before, docs_after)), ("spans_ok", protected_spans(docs_before, docs_after))):
        rows = rows.join(checks.select("doc_id", F.col("ok").alias(name)), "doc_id")
    rows = rows.join(counts, "doc_id", "left").join(stat, "doc_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ops_applied", "ops_rejected")})


def rewrite_guard(before: DataFrame, after: DataFrame, min_ratio: float = 0.2) -> DataFrame:
    """(doc_id, verdict): rejected (too few words left), unchanged or accepted."""
    rows = _pairs(before, after)
    few = word_count(F.col("new")) < word_count(F.col("old")) * min_ratio
    return rows.select("doc_id", F.when(trimmed(F.col("old")) == trimmed(F.col("new")), "unchanged").when(few, "rejected").otherwise("accepted").alias("verdict"))


def collapse_blank_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, content) with runs of blank lines as one, but for those in code fences. One fold
    over the lines of each document; no line leaves its row."""
    lines = F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.struct(x.alias("t"), trimmed(x).startswith("```").cast("int").alias("f"), (trimmed(x) == "").alias("b")))
    rows = docs.select("doc_id", lines.alias("l"))
    start = F.expr("named_struct('open', 0, 'out', cast(array() as array<struct<open:int>>))")
    fences = F.aggregate("l", start, lambda a, x: F.struct(((a["open"] + x["f"]) % 2).alias("open"), F.concat(a["out"], F.array(F.struct(a["open"].alias("open")))).alias("out")), lambda a: a["out"])
    rows = rows.select("doc_id", "l", fences.alias("o"))
    drop = lambda x, i: x["b"] & (F.get("o", i)["open"] == 0) & F.coalesce(F.get("l", i - 1)["b"] & (F.get("o", i - 1)["open"] == 0), F.lit(False)) & (i > 0)
    kept = F.transform(F.filter("l", lambda x, i: ~drop(x, i)), lambda x: F.when(x["b"], F.lit("")).otherwise(x["t"]))
    return rows.select("doc_id", F.array_join(kept, "\n").alias("content"))


class _Suffixes:
    """Longest common subsequences of all suffixes of two lists of lines, a bit each: bit m - 1 - j
    of row i is clear if line j adds one to what lines i.. of ``a`` share with lines j.. of ``b``.
    A row follows from the one under it by a few operations on whole integers (bit-parallel
    dynamic programming). Only every so many rows are kept, some sqrt(n); those between are made
    again, a stretch at a time, as the walk comes down to them."""

    def __init__(self, a: list[str], b: list[str]):
        self.a, self.n, self.m = a, len(a), len(b)
        self.full = (1 << self.m) - 1
        self.places: dict[str, list[int]] = {}
        for j, x in enumerate(b):
            self.places.setdefault(x, []).append(self.m - 1 - j)
        self.masks: dict[str, int] = {}
        self.every = max(1, int(self.n**0.5))
        self.kept, row = {self.n: self.full}, self.full
        for i in range(self.n - 1, -1, -1):
            row = self._above(i, row)
            if i % self.every == 0:
                self.kept[i] = row
        self.part: dict[int, int] = {}

    def _mask(self, x: str) -> int:
        at = self.places.get(x, ())
        if len(at) < 64:  # few of these bits: set when asked for
            return sum(1 << p for p in at)
        if x not in self.masks:  # at most m / 64 lines are this frequent
            digits = bytearray(self.m // 8 + 1)
            for p in at:
                digits[p >> 3] |= 1 << (p & 7)
            self.masks[x] = int.from_bytes(digits, "little")
        return self.masks[x]

    def _above(self, i: int, row: int) -> int:
        shared = row & self._mask(self.a[i])
        return ((row + shared) | (row ^ shared)) & self.full

    def rows(self, i: int) -> tuple[int, int]:
        """Row i and the one under it."""
        if i not in self.part or i + 1 not in self.part:
            end = min(self.n, (i // self.every + 1) * self.every)
            self.part = {end: self.kept[end]}
            for k in range(end - 1, i - 1, -1):
                self.part[k] = self._above(k, self.part[k + 1])
        return self.part[i], self.part[i + 1]

    def down(self, i: int, j: int) -> int:
        """By how much the suffixes at (i, j) share more than those at (i + 1, j)."""
        low = (1 << (self.m - j)) - 1
        here, under = self.rows(i)
        return (under & low).bit_count() - (here & low).bit_count()

    def right(self, row: int, j: int) -> int:
        return 1 - (row >> (self.m - 1 - j) & 1)


def _diff(a: list[str], b: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Line diff along a longest common subsequence: equal lines are taken wherever they meet, and
    deletions come first on ties. Time is len(a) * len(b) bits, memory sqrt(len(a)) rows of
    len(b) bits, for lists of any length."""
    shared = _Suffixes(a, b)
    out, i, j, gain = [], 0, 0, None
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(("same", i, j))
            i, j, gain = i + 1, j + 1, None
            continue
        row, under = shared.rows(i)
        gain = shared.down(i, j) if gain is None else gain
        step = shared.right(row, j)
        if gain <= step:
            out.append(("delete", i, None))
            i, gain = i + 1, None
        else:
            out.append(("insert", None, j))
            j, gain = j + 1, gain - step + shared.right(under, j)
    return out + [("delete", k, None) for k in range(i, len(a))] + [("insert", None, k) for k in range(j, len(b))]


def _diff_lines(old: str | None, new: str | None) -> list[tuple[str, str]]:
    a, b = ((t.split("\n") if t else []) for t in (old, new))
    h, most = 0, min(len(a), len(b))
    while h < most and a[h] == b[h]:
        h += 1
    x, y = a[h:], b[h:]
    return [("same", s) for s in a[:h]] + [(o, x[i] if i is not None else y[j]) for o, i, j in _diff(x, y)]


def line_diff(pairs: DataFrame, rows_out: int = 50_000) -> DataFrame:
    """(doc_id, seq, op, line) of each pair (doc_id, old, new), one path for pairs of any length:
    an equal begin is set aside (an equal end would change ties), the rest is diffed exactly. Some
    ``rows_out`` lines are handed on together. A null or empty text has no lines."""
    kind = pairs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda out: pd.DataFrame(out, columns=["doc_id", "seq", "op", "line"])
        out = []
        for rows in batches:
            for d, old, new in zip(rows["doc_id"], rows["old"], rows["new"], strict=True):
                out += [(d, k, o, s) for k, (o, s) in enumerate(_diff_lines(old, new))]
                if len(out) >= rows_out:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)

    return pairs.select("doc_id", "old", "new").mapInPandas(run, f"doc_id {kind}, seq int, op string, line string")


def pending_proposals(proposals: DataFrame, docs: DataFrame, now, ttl_minutes: int = 30) -> DataFrame:
    """(file_id, user, created_at, fresh) of live proposals (file_id, user, created_at,
    content_hash): the newest of each file and user, younger than the time to live at ``now``;
    ``fresh`` is false if the document's hash has changed since."""
    newest = W.partitionBy("file_id", "user").orderBy(F.col("created_at").desc(), F.col("content_hash"))
    rows = proposals.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")
    at = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    live = rows.filter(F.col("created_at") + F.expr(f"INTERVAL {ttl_minutes} MINUTES") > at)
    hashes = docs.select("file_id", F.col("content_hash").alias("current"))
    return live.join(hashes, "file_id", "left").select("file_id", "user", "created_at", F.col("content_hash").eqNullSafe(F.col("current")).alias("fresh"))
