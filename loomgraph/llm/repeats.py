"""Operator 6 - removal of long repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. The work
is in four steps, each a Spark job over all texts.

1. Anchors. Every window of ``length`` bytes picks the position of the smallest hash of the
   ``gram``-byte strings in it: a function of the window's bytes, so equal windows pick equal
   anchors. Runs of windows with one anchor, and the bytes they span (a region), are counted by
   anchor and by content. A region seen twice is repeated as a whole; an anchor with one region
   holds no other repeat. Counting uses map-side sums, and frequent regions and anchors are
   joined by broadcast, so a passage in a third of all texts costs nothing.
2. Shards. Only anchors with several different regions are open. One copy of each such region
   is dealt to a shard of bounded size by its anchor, so equal windows meet in one shard. In
   each shard a suffix array (Larsson-Sadakane, numpy) and its common prefixes (Kasai) tell
   which windows are repeated.
3. Hot anchors. If an anchor has more regions than a shard may hold, they are dealt to several
   shards; what each finds single goes, as sorted window hashes, to merge tasks that look up
   every shard's sorted run in the others' by binary search.
4. Marked windows become spans of each text.

Defined results: a null text counts as an empty one; texts under ``length`` bytes keep all;
repeated rows (same id and text) are repeats of each other; a null doc_id is a row like any
other; an empty table gives an empty result; extra columns pass through ``without_repeats``
untouched, even if named like its own (those are prefixed with ``_rep_``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import condensed, dealt, joined_by_weight, written
from .suffixes import byte_words, common_prefixes, suffix_array

GAP = 0xFF  # in no UTF-8 text


@dataclass(frozen=True)
class Repeats:
    length: int = 400
    gram: int = 32
    shard_bytes: int = 3_000_000
    hot_regions: int = 4_000  # regions of one anchor in one shard
    merge_regions: int = 10_000  # regions of one anchor whose windows meet in one merge task
    stretch: int = 1 << 22  # bytes looked at together


def anchored_runs(buf: np.ndarray, cuts: list[tuple[int, int]], p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of the runs in the texts at ``cuts``."""
    n, span = len(buf), p.length - p.gram + 1
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if n < p.length:
        return none
    words = byte_words(buf)
    m = n - p.gram + 1
    h = np.zeros(m, np.uint64)
    for k, c in zip(range(0, p.gram, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), strict=True):
        h ^= (words[k : k + m] ^ (h >> np.uint64(29))) * np.uint64(c)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(m, dtype=np.uint64)
    # Sliding minimum: of the blocks' running minima from the left and from the right.
    pad = -m % span
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - p.length + 1
    anchor = (np.minimum(right[:starts], left[span - 1 : span - 1 + starts]) & low).astype(np.int64)
    for a, b in cuts:  # windows that would leave their text
        anchor[max(a, b - p.length + 1) : b] = -1
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.append(first, starts))
    real = anchor[first] >= 0
    first, count = first[real], count[real]
    return first, count, h[anchor[first]]


RUNS = "k long, off long, cnt int, anchor long, ra long, rb long"


def _runs(texts: DataFrame, p: Repeats) -> DataFrame:
    def flush(parts: list[bytes], meta: list[tuple[int, int]]) -> pd.DataFrame:
        data = b"".join(parts)
        buf = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(x) for x in parts])
        begins = ends - [len(x) for x in parts]
        first, count, anchor = anchored_runs(buf, list(zip(begins.tolist(), ends.tolist(), strict=True)), p)
        own = np.searchsorted(begins, first, side="right") - 1
        k, base = (np.array([x[i] for x in meta], dtype=np.int64) for i in range(2))
        tail = p.length - 1
        view = memoryview(data)
        digest = b"".join([blake2b(view[a : a + c + tail], digest_size=16).digest() for a, c in zip(first.tolist(), count.tolist(), strict=True)])
        region = np.frombuffer(digest, "<i8").reshape(-1, 2)
        return pd.DataFrame({"k": k[own], "off": first - begins[own] + base[own], "cnt": count.astype(np.int32), "anchor": anchor.view(np.int64), "ra": region[:, 0], "rb": region[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, meta, size = [], [], 0
        for b in batches:
            for k, text in zip(b["k"].tolist(), b["text"].tolist(), strict=True):
                data = text.encode("utf-8")
                if len(data) < p.length:
                    continue
                for s in range(0, len(data) - p.length + 1, p.stretch):
                    parts.append(data[s : s + p.stretch + p.length - 1])
                    meta.append((k, s))
                    size += len(parts[-1])
                    if size >= p.stretch:
                        yield flush(parts, meta)
                        parts, meta, size = [], [], 0
        if parts:
            yield flush(parts, meta)

    return texts.select("k", "text").mapInPandas(run, RUNS)


#: A shard's finds: marked windows of a text, or one of its sorted runs for a hot anchor.
FOUND = "k long, off long, cnt int, anchor long, range int, shard long, run binary, regions binary"
#: An entry of a run: window hash, its region in ``regions``, place in it, whether single here.
ENTRY = np.dtype([("hash", "<i8"), ("region", "<i4"), ("at", "<i4"), ("single", "?")])


def _shard_windows(p: Repeats):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["anchor", "ra", "rb"]).sort_values(["anchor", "ra", "rb"])
        gap = bytes([GAP])
        raw = gap.join(rows["bytes"].tolist())
        data = np.frombuffer(raw, np.uint8)
        sizes = rows["bytes"].map(len).to_numpy()
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
        sa, _ = suffix_array(data)
        tie = common_prefixes(data, sa) >= p.length
        again = np.zeros(len(data), bool)
        again[sa] = tie | np.append(tie[1:], False)
        lead = np.zeros(len(data), bool)  # the first of each class of equal windows
        lead[sa] = ~tie
        out, entries = [], []
        hot = bool(rows["hot"].iloc[0])  # a hot anchor's shard holds no other anchor
        for i, (a, size, k, off, n) in enumerate(zip(begin.tolist(), sizes.tolist(), rows["k"], rows["off"], rows["n"], strict=True)):
            own = again[a : a + size - p.length + 1]
            if n == 1:
                edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                out += [(k, off + s, e - s, None, None, None, None, None) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            if hot:
                for s in np.flatnonzero(lead[a : a + len(own)]).tolist():
                    h = int.from_bytes(blake2b(raw[a + s : a + s + p.length], digest_size=8).digest(), "little", signed=True)
                    entries.append((h, i, s, not (own[s] or n > 1)))
        if hot:
            known = np.sort(np.array(entries, ENTRY), order="hash")
            ranges, anchor, shard = (int(rows[c].iloc[0]) for c in ("ranges", "anchor", "shard"))
            regions = rows[["k", "off"]].to_numpy(np.int64).tobytes()
            where = (known["hash"] % ranges).astype(int)
            out += [(None, None, None, anchor, r, shard, known[where == r].tobytes(), regions) for r in range(ranges)]
        columns = dict(zip(("k", "off", "cnt", "anchor", "range", "shard", "run", "regions"), zip(*out, strict=True) if out else [()] * 8, strict=True))
        # Nullable integers from the start: a detour over floats would round 64-bit keys.
        return pd.DataFrame({c: pd.array(list(v), "Int64") if c not in ("run", "regions") else pd.Series(list(v), dtype=object) for c, v in columns.items()})

    return run


def _merge_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows single in their shard that another shard of the same anchor holds too: each
    shard's sorted run is looked up in every other by binary search."""
    runs = [np.frombuffer(x, ENTRY) for x in rows["run"]]
    merged = np.sort(np.concatenate([r["hash"] for r in runs]))
    out = []
    for r, regions in zip(runs, rows["regions"], strict=True):
        keys = np.ascontiguousarray(r["hash"])
        met = np.searchsorted(merged, keys, side="right") - np.searchsorted(merged, keys, side="left") > 1
        hit = r[met & r["single"]]
        at = np.frombuffer(regions, "<i8").reshape(-1, 2)[hit["region"]]
        out.append(pd.DataFrame({"k": at[:, 0], "off": at[:, 1] + hit["at"], "cnt": np.ones(len(hit), np.int32)}))
    return pd.concat(out)


SPANS = "k long, spans array<struct<s:long,e:long>>"


def _merge_spans(p: Repeats):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for marks in b["marks"]:
                starts = np.array([m["off"] for m in marks], np.int64)
                ends = starts + np.array([m["cnt"] for m in marks], np.int64) + p.length - 1
                order = np.argsort(starts, kind="stable")
                starts, ends = starts[order], np.maximum.accumulate(ends[order])
                new = np.concatenate(([True], starts[1:] > ends[:-1]))
                last = np.append(new[1:], True)
                out.append([{"s": int(s), "e": int(e)} for s, e in zip(starts[new], ends[last], strict=True)])
            yield pd.DataFrame({"k": b["k"], "spans": out})

    return run


def repeated_spans(docs: DataFrame, p: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, spans): the byte ranges [s, e) that repeats cover of each text that has any, by its id
    ``k``. Ids must be unique and not null."""
    return condensed("spans", lambda: _spans_of(docs, p, id_col, text_col))


def _spans_of(docs: DataFrame, p: Repeats, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs = written(_runs(texts, p), "runs")
    region = ["anchor", "ra", "rb"]
    often = written(runs.groupBy(*region).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    whole = joined_by_weight(runs, often, region, "n").select("k", "off", "cnt")

    ends = F.min("ra").alias("lo"), F.max("ra").alias("hi")
    crowded = written(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("total"), *ends).filter("lo <> hi").select("anchor", "total"), "crowded")
    one_each = F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "off", "cnt")).alias("rep")
    seen = written(joined_by_weight(runs, crowded, ["anchor"], "total").groupBy(*region).agg(*one_each), "regions")
    kinds = written(seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).withColumn("weight", F.col("kinds")), "kinds")
    open_ = joined_by_weight(seen, kinds, ["anchor"], "weight").select(*region, "n", "kinds", "rep.*")
    size = open_.agg(F.sum(F.col("cnt") + p.length)).first()[0] or 0
    shards = max(1, -(-size // p.shard_bytes))
    hot = F.col("kinds") > p.hot_regions
    part = F.ceil(F.col("kinds") / p.hot_regions)
    shard = F.when(hot, F.xxhash64("anchor", F.pmod(F.col("ra"), part)).bitwiseOR(F.lit(1 << 62))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    piece = F.expr(f"substring(cast(text as binary), cast(off + 1 as int), cast(cnt + {p.length - 1} as int))")
    ranges = F.ceil(F.col("kinds") / p.merge_regions).cast("int")
    filled = texts.join(open_, "k").select("k", "off", *region, "n", hot.alias("hot"), shard.alias("shard"), ranges.alias("ranges"), piece.alias("bytes"))
    found = written(filled.groupBy("shard").applyInPandas(_shard_windows(p), FOUND), "found")
    crossed = found.filter("shard IS NOT NULL").groupBy("anchor", "range").applyInPandas(_merge_runs, "k long, off long, cnt int")
    marks = whole.unionByName(found.filter("shard IS NULL").select("k", "off", "cnt")).unionByName(crossed)
    return marks.groupBy("k").agg(F.collect_set(F.struct("off", "cnt")).alias("marks")).mapInPandas(_merge_spans(p), SPANS)


def cut_text(text: Column, spans: Column) -> Column:
    """``text`` without the byte ranges ``spans``, each widened to whole characters: what a range
    leaves of a character that it cuts goes as well, and every other character stays."""
    raw = text.cast("binary")
    size = F.octet_length(text).cast("long")
    inside = lambda i: F.substring(raw, (i + 1).cast("int"), F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    begin = lambda s: s - F.when(~inside(s), 0).when(~inside(s - 1), 1).when(~inside(s - 2), 2).otherwise(3)
    end = lambda e: e + F.when(~inside(e), 0).when(~inside(e + 1), 1).when(~inside(e + 2), 2).otherwise(3)
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: end(x["e"]))),
        F.concat(F.transform(spans, lambda x: begin(x["s"])), F.array(size)),
        lambda a, b: F.substring(raw, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).cast("string"),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(gaps, ""))


def without_repeats(docs: DataFrame, p: Repeats = Repeats(), text_col: str = "text") -> DataFrame:
    """``docs`` with ``_rep_bytes`` (length), ``_rep_spans`` and ``_rep_kept`` (what is left). The
    texts are shuffled once, into buckets of their rows' numbers: the joins with what is found,
    of pieces to compare and of spans to cut, move what is found alone."""
    rows, n = dealt(docs, "texts")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    spans = repeated_spans(rows, p, n, text_col).select(F.col("k").alias(n), F.col("spans").alias("_rep_spans"))
    keyed = rows.join(spans, n, "left").select(*docs.columns, "_rep_spans")
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    keyed = keyed.withColumns({"_rep_bytes": size, "_rep_spans": F.coalesce("_rep_spans", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"))})
    # What is left: from each span's end (and from 0) to the next span's start (and to the end).
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.transform("_rep_spans", lambda x: x["e"])),
        F.concat(F.transform("_rep_spans", lambda x: x["s"]), F.array("_rep_bytes")),
        lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")),
    )
    kept = F.when(F.size("_rep_spans") == 0, raw).otherwise(F.unhex(F.array_join(F.transform(gaps, lambda x: F.hex(x)), "")))
    return keyed.withColumn("_rep_kept", kept)
