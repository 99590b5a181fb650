"""Operator 1 - SentencePiece N-best encoding and decoding.

The pieces of a public model span a lattice over the normalised text. Forward Viterbi scores
are the exact cost to come of every lattice node, so an A-star search from the end that adds
them as its heuristic meets complete segmentations in order of their scores. The score of a
path is the sum of its pieces' scores; a character in no piece costs the least score less 10,
as in the library, and is written as byte pieces if the model has them.

Where no piece holds a word mark after another character (or a line break at all), the lattice
falls apart at these places: each stretch is searched once per worker and remembered, and the
N best of a text are merged from those of its stretches. Models without that property are
searched as one stretch.

Result per row: ``ids`` of the best segmentation (little-endian unsigned 32-bit), its ``score``,
and ``others``: the next best ones as replacements of token ranges in the best one, which stay
small however long the text is.

Defined results: null and empty texts have no ids, score 0 and no others; ties are broken by
the search's order, a function of the text alone; fewer than N segmentations give fewer
others; repeated rows are encoded alike; extra columns pass through.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import plain

MARK = "▁"
UNKNOWN_COST = 10.0
LOW = float("-inf")
Path = tuple[float, tuple[int, ...]]


class Pieces:
    """The lattice of one SentencePiece model file."""

    ROOM = 350_000  # stretches remembered, and as many of those before

    def __init__(self, path: str):
        import sentencepiece

        own = self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = own.vocab_size()
        names = [own.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (own.is_byte(i) or own.is_unknown(i) or own.is_control(i) or own.is_unused(i))]
        self.trie: dict = {}  # by character; under 0 the (id, score) of a piece that ends here
        for i in plain:
            node = self.trie
            for c in names[i]:
                node = node.setdefault(c, {})
            node[0] = (i, own.get_score(i))
        self.steps = self._steps(self.trie)
        self.longest = max((len(names[i]) for i in plain), default=1)
        self.unknown_score = min((own.get_score(i) for i in plain), default=0.0) - UNKNOWN_COST
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if own.is_byte(i)}
        self.unk = own.unk_id()
        self.bytes_of = [bytes([int(n[3:5], 16)]) if own.is_byte(i) else n.encode() if not (own.is_control(i) or own.is_unknown(i)) else b"" for i, n in enumerate(names)]
        self.cut = self._cuts([names[i] for i in plain])
        self.seen: dict[str, tuple[bytes, float, float]] = {}
        self.older: dict[str, tuple[bytes, float, float]] = {}
        self.more: dict[tuple[str, int], list[Path]] = {}

    @classmethod
    def _steps(cls, node: dict) -> dict:
        """The trie as (next ones, id or -1, score) by character, which ``first`` reads with one lookup a step."""
        return {c: (cls._steps(after), *after.get(0, (-1, 0.0))) for c, after in node.items() if c}

    @staticmethod
    def _cuts(pieces: list[str]) -> re.Pattern | None:
        """Where no piece can lie across: before a word mark that follows another character, at
        line breaks, and between a letter and a mark such as a full stop, as far as no piece of
        this model holds such a pair. None if a piece holds a word mark inside."""
        pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        if any(b == MARK and a != MARK for a, b in pairs):
            return None
        if any("\n" in p for p in pieces):
            return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        letter = re.compile(r"[^\W\d_]")
        before: dict[str, set[str]] = {c: set() for c in ".,;:!?|*$%&#)\"'"}
        for a, b in pairs:
            if b in before and letter.match(a):
                before[b].add(a)
        marks = [c for c, found in before.items() if len(found) <= 8]  # a few odd letters are left out instead
        odd = re.escape("".join(sorted(set().union(*(before[c] for c in marks)))))
        ends = f"(?=[{re.escape(''.join(marks))}])" if marks else "(?!)"
        return re.compile(f"{MARK}*[^\\W\\d_{odd}]+{ends}|{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")

    def stretches(self, text: str) -> list[str]:
        return self.cut.findall(text) if self.cut else [text] if text else []

    def forward(self, text: str) -> tuple[list[float], list[list[tuple]]]:
        """Viterbi: the best score up to each position and the (start, ids, score) ways into it."""
        size, root = len(text), self.trie
        best = [LOW] * (size + 1)
        best[0] = 0.0
        into: list[list[tuple]] = [[] for _ in best]
        for s in range(size):
            here, node, single = best[s], root, False
            e = s
            for c in text[s : s + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                e += 1
                piece = node.get(0)
                if piece:
                    score = here + piece[1]
                    into[e].append((s, piece[0], piece[1]))
                    if score > best[e]:
                        best[e] = score
                    if e == s + 1:
                        single = True
            if not single:
                into[s + 1].append((s, self.unknown_ids(text[s]), self.unknown_score))
                if here + self.unknown_score > best[s + 1]:
                    best[s + 1] = here + self.unknown_score
        return best, into

    def nbest(self, text: str, n: int) -> list[Path]:
        """The up to n best (score, ids) of one stretch, best first: A-star from the end, whose
        heuristic, the forward score, is exact, so each popped state leads to the next best."""
        best, into = self.forward(text)
        heap = [(-best[-1], 0, len(text), 0.0, None)]
        found: list[Path] = []
        tick = 0
        while heap and len(found) < n:
            _, _, at, gone, path = heapq.heappop(heap)
            while at:  # follow the best way on; the others wait
                ways = into[at]
                k = max(range(len(ways)), key=lambda j: best[ways[j][0]] + ways[j][2])
                for j, (s, piece, score) in enumerate(ways):
                    if j != k:
                        tick -= 1
                        heapq.heappush(heap, (-(best[s] + score + gone), tick, s, gone + score, (piece, path)))
                s, piece, score = ways[k]
                at, gone, path = s, gone + score, (piece, path)
            ids: list[int] = []
            while path:
                piece, path = path
                if type(piece) is int:
                    ids.append(piece)
                else:
                    ids += piece
            found.append((gone, tuple(ids)))
        return found

    def first(self, text: str) -> tuple[bytes, float, float]:
        """(ids, score, gap to the second best): the search up to its first result. The state
        that would be taken up next is the second best way into some node of the best path, as
        the heuristic is exact, so the forward pass keeps just the two best ways into a node."""
        size, root, longest = len(text), self.steps, self.longest
        best, second = [LOW] * (size + 1), [LOW] * (size + 1)
        best[0] = 0.0
        back: list = [None] * (size + 1)
        for s in range(size):
            here, steps, e, single = best[s], root, s, False
            for c in text[s : s + longest]:
                if c not in steps:
                    break
                steps, piece, score = steps[c]
                e += 1
                if piece >= 0:
                    score += here
                    if score > best[e]:
                        second[e], best[e], back[e] = best[e], score, (s, piece)
                    elif score > second[e]:
                        second[e] = score
                    if e == s + 1:
                        single = True
            if not single:
                score, e = here + self.unknown_score, s + 1
                if score > best[e]:
                    second[e], best[e], back[e] = best[e], score, (s, self.unknown_ids(text[s]))
                elif score > second[e]:
                    second[e] = score
        at, gap = size, -LOW
        ids: list[int] = []
        while at:
            gap = min(gap, best[at] - second[at])
            at, piece = back[at]
            if type(piece) is int:
                ids.append(piece)
            else:
                ids += piece[::-1]
        return struct.pack(f"<{len(ids)}I", *ids[::-1]), best[-1], gap

    def unknown_ids(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode("utf-8", "replace")) if self.byte_ids else (self.unk,)

    def encode(self, text: str | None, n: int = 4) -> tuple[bytes, float, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """(ids, score, others); others: (score, [(first token, tokens replaced, new ids)])."""
        parts = self.stretches(self.own.normalize(text or ""))
        if not parts:
            return b"", 0.0, []
        if len(self.seen) > self.ROOM:
            self.seen, self.older = {}, self.seen  # what comes again is taken over, so frequent stretches stay
        seen, older = self.seen, self.older
        for p in set(parts).difference(seen):
            seen[p] = older.get(p) or self.first(p)
        rows = list(map(seen.__getitem__, parts))
        bits, scores, gaps = zip(*rows, strict=True)
        score = float(sum(scores))
        if n < 2:
            return b"".join(bits), score, []
        # Only the n - 1 stretches with the smallest gap can take part in the n best.
        gap = np.array(gaps)
        near = np.flatnonzero(gap <= np.partition(gap, n - 2)[n - 2]) if len(gap) > n else np.arange(len(gap))
        near = near[np.argsort(gap[near], kind="stable")][: n - 1]
        merged: list[tuple[float, tuple[tuple[int, tuple[int, ...] | None], ...]]] = [(0.0, ())]
        for j in near.tolist():
            if gaps[j] < float("inf"):
                lost = [(scores[j] - s, ids if k else None) for k, (s, ids) in enumerate(self._several(parts[j], n))]
                merged = sorted(((a + b, (*c, (j, ids)) if ids else c) for a, c in merged for b, ids in lost), key=itemgetter(0))[:n]
        if len(merged) < 2:
            return b"".join(bits), score, []
        sizes = np.fromiter(map(len, bits), np.int64, len(bits)) // 4
        begin = np.cumsum(sizes) - sizes
        others = [(score - lost, [(int(begin[j]), int(sizes[j]), np.array(ids, "<u4").tobytes()) for j, ids in sorted(choice)]) for lost, choice in merged[1:]]
        return b"".join(bits), score, others

    def _several(self, stretch: str, n: int) -> list[Path]:
        if len(self.more) > self.ROOM // 10:
            self.more.clear()
        if (stretch, n) not in self.more:
            self.more[stretch, n] = self.nbest(stretch, n)
        return self.more[stretch, n]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; bad byte runs become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def worker_pieces(model: str) -> Pieces:
    """One lattice a Python worker: its stretches outlive a task."""
    return Pieces(model)


def applied(ids: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
    """The ids of one of the ``others``."""
    out, at = [], 0
    for first, n, new in changes:
        out += [ids[at : 4 * first], new]
        at = 4 * (first + n)
    return b"".join([*out, ids[at:]])


CHANGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("replaced", T.IntegerType()), T.StructField("ids", T.BinaryType())]))
OTHERS = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("changes", CHANGES)]))


def encode_nbest(docs: DataFrame, model: str, n: int = 4, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` without its text (unless kept) plus ``sp_ids``, ``sp_score``, ``sp_others`` and
    ``sp_same``: whether decoding the ids gives the text again."""
    kept = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("sp_ids", T.BinaryType()), T.StructField("sp_score", T.DoubleType()), T.StructField("sp_others", OTHERS), T.StructField("sp_same", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = worker_pieces(model)
        gc.disable()  # the lattice and its memory hold no cycles; scanning them again and again costs more than the search
        for b in batches:
            for k in range(0, len(b), 1000):
                part = b.iloc[k : k + 1000]
                found = [pieces.encode(t, n) for t in part[text_col]]
                others = [[{"score": s, "changes": [{"first": f, "replaced": m, "ids": i} for f, m, i in c]} for s, c in x[2]] for x in found]
                same = [pieces.decode(x[0]) == (t or "") for x, t in zip(found, part[text_col], strict=True)]
                yield plain(part[kept]).assign(sp_ids=[x[0] for x in found], sp_score=[x[1] for x in found], sp_others=others, sp_same=same)
        gc.freeze()  # what stays is not scanned again
        gc.enable()

    return docs.mapInPandas(run, schema)


def decode_ids(rows: DataFrame, model: str, ids_col: str = "sp_ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids in ``ids_col`` (null: null)."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = worker_pieces(model)
        for b in batches:
            yield plain(b).assign(**{out_col: [None if x is None else pieces.decode(x) for x in b[ids_col]]})

    return rows.mapInPandas(run, schema)


def digest(encoded: DataFrame, *keys: str) -> DataFrame:
    """Token counts, scores and checksums in place of the ids."""
    return encoded.select(
        *keys,
        (F.octet_length("sp_ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("sp_ids").alias("ids_crc32"),
        F.col("sp_score").alias("score"),
        F.transform("sp_others", lambda o: o["score"]).alias("other_scores"),
        F.transform("sp_others", lambda o: F.crc32(F.unhex(F.array_join(F.transform(o["changes"], lambda c: F.concat(F.lpad(F.hex(c["first"]), 8, "0"), F.lpad(F.hex(c["replaced"]), 8, "0"), F.hex(c["ids"]))), "")))).alias("other_crc32"),
        F.col("sp_same").alias("round_trip"),
    )
