"""Operator 4 - benchmark decontamination by the q-gram lemma over diagonal bands.

A benchmark item is covered by windows of ``window`` characters that start every ``2 * budget``
characters (one window if it is shorter): a verbatim excerpt of ``window`` characters or more lies
at most ``budget`` characters off one of them, which are edits within the budget at its end, so
wherever an excerpt is taken it is found. A document matches a window if some stretch of it is within ``budget`` edits
of it. The q-gram lemma says that such a stretch shares at least
``len - q + 1 - q * budget`` q-grams with the window, on at most ``2 * budget + 1`` neighbouring
diagonals: hits are counted in overlapping diagonal bands, regions that meet the bound are kept
(nothing within the budget can be lost), and a banded alignment decides.

Text is compared in lower case with white space runs as one space. The benchmark side is read
in blocks of a stated number of characters; one block is broadcast at a time, so its size never
grows with the benchmark. Documents are handled in stretches of a fixed length that overlap by
more than a match can span: memory is bounded for texts of any length.

Items shorter than ``min_item`` characters, for which the lemma has little bound left, are found
verbatim, as whole words, by the hash of all their characters.

Defined results: null or empty texts and items match nothing; repeated document rows are
reported once; ties between equal matches go to the earlier window of the item; a null doc_id is kept as null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 1 << 40  # no character
BLANK = 32
SCHEMA = "doc_id long, item_id long, item_start int, doc_start long, doc_end long, edits int"


@dataclass(frozen=True)
class Limits:
    q: int = 10
    window: int = 96
    budget: int = 7  # edits in a full window; shorter windows get a proportional share
    band: int = 16  # diagonals in a band besides the overlap of 2 * budget
    min_item: int = 40  # shorter items must be there verbatim
    stretch: int = 1 << 18  # characters of a document looked at together
    block_chars: int = 4_000_000  # benchmark characters broadcast at a time


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, by doubling: four or so passes for any q."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    out: np.ndarray | None = None
    done, part, size, power = 0, c * mul ^ (c >> np.uint64(3)), 1, int(mul)
    while size <= q:
        if q & size:
            out = part.copy() if out is None else out[: len(c) - q + 1 + (q - done - size)] * np.uint64(power) + part[done : done + len(c) - q + 1 + (q - done - size)]
            done += size
        if 2 * size <= q:
            part = part[: len(part) - size] * np.uint64(power) + part[size:]
        size, power = 2 * size, power * power % (1 << 64)
    out = out[: len(c) - q + 1]
    return out ^ (out >> np.uint64(29))


class Index:
    """The windows of one benchmark block and their sorted q-grams."""

    def __init__(self, items: list[tuple[int, str]], lim: Limits):
        self.lim, self.text, self.item, self.start, self.budget = lim, [], [], [], []
        short: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            c = codes(normalised(text))
            if len(c) < lim.min_item:
                if len(c):
                    short.setdefault(len(c), []).append((item_id, c))
                continue
            w = min(lim.window, len(c))
            for s in sorted({*range(0, len(c) - w, max(1, 2 * lim.budget)), len(c) - w}):
                self.text.append(c[s : s + w])
                self.item.append(item_id)
                self.start.append(s)
                self.budget.append(max(0, min(lim.budget, lim.budget * w // lim.window, (w - lim.q) // lim.q)))
        hashes = [gram_hashes(t, lim.q) for t in self.text]
        self.need = np.array([len(t) - lim.q + 1 - lim.q * b for t, b in zip(self.text, self.budget, strict=True)], dtype=np.int64)
        grams = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.win = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order] if hashes else np.empty(0, np.int64)
        self.pos = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else np.empty(0, np.int64)
        self.gram, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - 22)
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.gram >> self.shift).astype(np.int64)] = True

        # Short items are numbered after the windows: by length, their sorted hashes, numbers and characters.
        self.short = []
        for n, found in sorted(short.items()):
            h = np.array([gram_hashes(c, n)[0] for _, c in found])
            order = np.argsort(h, kind="stable").tolist()
            self.short.append((n, h[order], [(len(self.item) + i, found[i][1]) for i in order]))
            self.item += [item_id for item_id, _ in found]
            self.start += [0] * len(found)

    def verbatim(self, c: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(number, start, end) of the short items in ``c`` as whole words."""
        for n, hashes, found in self.short:
            h = gram_hashes(c, n)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            at = np.flatnonzero(hashes[k] == h)
            ahead, behind = c[np.maximum(at - 1, 0)], c[np.minimum(at + n, len(c) - 1)]
            apart = ((at == 0) | (ahead == BLANK) | (ahead == GAP)) & ((at + n == len(c)) | (behind == BLANK) | (behind == GAP))
            for s in at[apart].tolist():
                for i in range(int(np.searchsorted(hashes, h[s])), int(np.searchsorted(hashes, h[s], side="right"))):
                    if (found[i][1] == c[s : s + n]).all():
                        yield found[i][0], s, s + n

    def regions(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, band start diagonal) of the bands of ``c`` that meet the lemma's bound."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        h = gram_hashes(c, self.lim.q)
        at = np.flatnonzero(self.seen[(h >> self.shift).view(np.int64)]) if len(h) and len(self.gram) else none[0]
        if not len(at):
            return none
        k = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        hit = self.gram[k] == h[at]
        at, k = at[hit], k[hit]
        n = self.count[k]
        doc = np.repeat(at, n)
        ref = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else none[0]
        if not len(doc):
            return none
        win, diag = self.win[ref], doc - self.pos[ref] + self.lim.window  # diagonals from 0
        lap = 2 * self.lim.budget
        band = diag // self.lim.band
        back = (diag % self.lim.band < lap) & (band > 0)
        steps = [(win, band, doc)]
        for j in range(1, lap // self.lim.band + 2):  # a diagonal lies in each band that reaches over it
            back = (diag - (band - j) * self.lim.band < self.lim.band + lap) & (band >= j)
            steps.append((win[back], band[back] - j, doc[back]))
        win, band, doc = (np.concatenate(x) for x in zip(*steps, strict=True))
        cell, rows = np.unique(win * (1 << 32) + band, return_inverse=True)
        least = self.need[cell >> 32]
        many = np.bincount(rows, minlength=len(cell)) >= least  # before the sort: most bands end here
        keep = many[rows]
        key = np.unique(rows[keep].astype(np.int64) * (1 << 32) + doc[keep])  # distinct positions
        enough = np.bincount(key >> 32, minlength=len(cell)) >= least
        return cell[enough] >> 32, (cell[enough] & 0xFFFFFFFF) * self.lim.band - self.lim.window

    def aligned(self, c: np.ndarray, wins: np.ndarray, diags: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, start, end, edits) of the candidates that a banded alignment confirms; all
        candidates of one window length step through the same rows together."""
        out = []
        width = self.lim.band + 4 * self.lim.budget + 1
        for w in {len(self.text[i]) for i in wins}:
            own = np.array([len(self.text[i]) == w for i in wins])
            ids, low = wins[own], diags[own] - self.lim.budget
            pad = np.concatenate([np.full(width + self.lim.window, GAP, np.uint64), c, np.full(2 * width + self.lim.window, GAP, np.uint64)])
            base = low + width + self.lim.window  # of column 0 in row 0
            query = np.stack([self.text[i] for i in ids])
            cols = np.arange(width)
            cost = np.zeros((len(ids), width), np.int32)  # a match may start on any diagonal of the band
            begin = low[:, None] + cols[None, :]
            for r in range(w):
                char = pad[np.clip(base[:, None] + r + cols[None, :], 0, len(pad) - 1)]
                best, from_ = cost + (char != query[:, r : r + 1]), begin
                up = np.full_like(cost, 1 << 20)
                up[:, :-1] = cost[:, 1:] + 1  # a character of the window is missing here
                better = up < best
                best = np.where(better, up, best)
                from_ = np.where(better, np.concatenate([begin[:, 1:], begin[:, -1:]], axis=1), from_)
                # characters of the document that the window lacks: a running minimum along the row
                lag = (best - cols[None, :]).astype(np.int64) * width + cols[None, :]
                at = np.minimum.accumulate(lag, axis=1) % width
                cost = np.take_along_axis(best, at, 1) + cols[None, :] - at
                begin = np.take_along_axis(from_, at, 1)
            last = cost.argmin(axis=1)
            edits = cost[np.arange(len(ids)), last]
            for x, i in enumerate(ids):
                if edits[x] <= self.budget[i]:
                    out.append((int(i), int(max(0, begin[x, last[x]])), int(min(len(c), low[x] + last[x] + w)), int(edits[x])))
        return out

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(index of the text, window or short item, start, end, edits). Texts are laid end to end
        with a gap that no match can cross, and looked at a stretch at a time; each stretch repeats
        the last ``lap`` characters of the one before, so that no match is cut."""
        lap = 4 * self.lim.window
        gap = np.full(self.lim.window, GAP, np.uint64)
        parts: list[np.ndarray] = []
        places: list[tuple[int, int, int, int, bool]] = []  # where a piece starts here, which text it is of, its offset there, where it ends here, whether the text does
        used = 0

        def scan() -> Iterator[tuple[int, int, int, int, int]]:
            c = np.concatenate(parts)
            ends = np.array([x[3] for x in places])
            for i, a, b in self.verbatim(c):
                at, text, offset, end, last = places[int(np.searchsorted(ends, a, side="right"))]
                # Where a long text is cut is no end of a word; the stretch beside it has all of it.
                if (a > at or not offset) and (b < end or last):
                    yield text, i, a - at + offset, b - at + offset, 0
            wins, diags = self.regions(c)
            if len(wins):
                for i, a, b, e in self.aligned(c, wins, diags):
                    # First or last letters that the piece lacks may be paid for with gap characters:
                    # a begin in a gap belongs to the piece after it.
                    at, text, offset, end, _ = places[int(np.searchsorted(ends, a, side="right"))]
                    yield text, i, max(a, at) - at + offset, min(b, end) - at + offset, e

        for n, text in enumerate(texts):
            c = codes(normalised(text))
            for s in range(0, max(1, len(c) - lap), self.lim.stretch):
                piece = c[s : s + self.lim.stretch + lap]
                places.append((used, n, s, used + len(piece), s + len(piece) == len(c)))
                parts += [piece, gap]
                used += len(piece) + len(gap)
                if used >= self.lim.stretch:
                    yield from scan()
                    parts, places, used = [], [], 0
        if parts:
            yield from scan()


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, lim: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (document, item): where the closest window of the item lies in the
    normalised document, and its edits."""
    spark = docs.sparkSession
    items = benchmark.filter(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // lim.block_chars) or 1
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found: DataFrame | None = None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.select("item_id", "text").distinct().collect()])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index(shared.value, lim)
            for b in batches:
                ids = b["doc_id"].tolist()
                rows = [(ids[x], index.item[i], index.start[i], s, e, n) for x, i, s, e, n in index.matches(b["text"].tolist())]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "item_start", "doc_start", "doc_end", "edits"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        part = texts.mapInPandas(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct("edits", "item_start", "doc_start", "doc_end"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m"), F.count_distinct("item_start").alias("n_windows")).select("doc_id", "item_id", "n_windows", "m.*")
