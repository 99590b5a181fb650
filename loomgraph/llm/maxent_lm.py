"""Operator 8 - hashed maximum-entropy language model with a class-factored softmax.

p(w | h) = p(class(w) | h) * p(w | class(w), h). Both factors are log-linear in hashed features of
the context h.

Class factor: the word before (bigram), the two before (trigram) and single words two and three
back (skips) are rows of ``classes`` weights in a table of ``buckets`` rows for each type of
feature. Weights start from one scaling step on the summed counts; each further round sums the
gradient (observed less expected counts) over all training tokens and moves every weight by a
quarter of the logarithm of their ratio, so four features a token never overshoot. Sums are over
the whole corpus: the result does not hang on the number of tasks.

Word factor: each pair of the word before and the word has a feature of its own, found by a hash.
From the word's share p0 of its class, the scaling step with ``kappa`` prior tokens gives weight
log(1 + n(pair) / (kappa * p0)), whose normaliser is 1 + n(word before, class) / kappa. Two counts
thus settle a token. Frequent words are classes of their own and need no word factor; the others
share classes by their first letters.

The pairs grow with the corpus and no task holds all of them. Jobs, all over whole texts:

1. one pass turns texts into arrays of word numbers by chunks of texts; the later ones read these;
2. word counts, keyed by 64-bit hashes of the words and summed by ranges of them; the most
   frequent words (at most ``head``) are broadcast;
3. class counts are summed by task; the rounds of the class factor follow, with its table
   broadcast (it grows with the cube root of the tokens);
4. each chunk's pairs and rarer words are cut by ranges of their hashes, which grow in number with
   the tokens; a range sums its counts and answers each chunk; a frequent word before is dealt to
   as many ranges as its successors have classes;
5. chunks are scored in numpy batches with the answers sent to them.

Every class gives the mass of one unseen word to words not in training, so p sums to one over
the vocabulary and one unknown word a class. Defined results: null and empty texts hold the end
token alone; repeated rows are scored alike; a null doc_id is in no training fold and not held
out; a text of any length is one chunk at most; of words with equal counts the smaller hash is
the more frequent; without any training text every count is 0 and p comes from the smoothing; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_written, written

END = b""  # no word is empty
SMOOTH = 0.1
FEATURES = 4


@dataclass(frozen=True)
class Shape:
    classes: int = 64
    singles: int = 24  # frequent words that are classes of their own
    buckets: int = 1 << 13  # of one type of feature, at least
    head: int = 1 << 19
    prior: float = 1.0  # tokens as by the class distribution that each row begins with
    kappa: float = 2.0  # tokens as by the word's share of its class that each context begins with
    rounds: int = 1  # of the class factor, after the first scaling step
    chunk: int = 1 << 20  # tokens of a chunk, about
    range_tokens: int = 1 << 21  # tokens of a range of hashes, about

    def sized(self, tokens: int) -> Shape:
        """Buckets for so many training tokens: four times their cube root, or ``buckets``."""
        least = max(self.buckets, int(4 * np.cbrt(tokens)), 2)
        return replace(self, buckets=1 << (least - 1).bit_length())

    def range_bits(self, tokens: int) -> int:
        return (max(64, -(-tokens // self.range_tokens)) - 1).bit_length()

    def key_bits(self, tokens: int) -> int:
        """Bits of a context's hash: 12 more than tell the tokens apart."""
        return min(64, max(20, tokens.bit_length()) + 12)


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words and one end; bytes, so that case and space are ASCII only."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 7)
    return h - (1 << 64) if h >> 63 else h


class Letters(dict):
    """Class of the words that begin with the given bytes: two characters take eight at most."""

    def __init__(self, shape: Shape):
        super().__init__()
        self.shape = shape

    def __missing__(self, first: bytes) -> int:
        chars = first.decode("utf-8", "ignore")[:2].encode()
        out = self.shape.singles + xxhash.xxh32_intdigest(chars, 3) % (self.shape.classes - self.shape.singles)
        if len(self) < 1 << 18:
            self[first] = out
        return out


def word_counts(texts: DataFrame, shape: Shape) -> DataFrame:
    """(h, cls, c) of every distinct token of ``texts``."""
    return counts_of(written(tokenised(texts.withColumn("learn", F.lit(True)), shape), "tokens"))


def counts_of(passed: DataFrame) -> DataFrame:
    """(h, cls, c) of every distinct training token in the chunks, by ranges of the hashes."""
    bits = (4 * int(passed.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["data"]:
                t, sizes, _, _, learn, h, letter = unpacked(data)
                n = np.bincount(t[np.repeat(learn, sizes)], minlength=len(h))
                order = np.argsort(h.view(np.uint64))
                order = order[n[order] > 0]
                keys, letter, n = h.view(np.uint64)[order], letter[order], n[order]
                yield _rows(WORD, [(r, 0, packed(np.diff(keys[a:e], prepend=np.uint64(0)), letter[a:e], n[a:e])) for r, a, e in slices(keys, bits)])

    def add(df: pd.DataFrame) -> pd.DataFrame:
        got = [unpacked(x) for x in df["data"]]
        keys, first, which = np.unique(np.concatenate([np.cumsum(x[0]) for x in got]), return_index=True, return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([x[2] for x in got])).astype(np.int64)
        return pd.DataFrame({"h": keys.view(np.int64), "cls": np.concatenate([x[1] for x in got])[first].astype(np.int32), "c": n})

    return passed.mapInPandas(cut, PASS).groupBy("at").applyInPandas(add, "h long, cls int, c long")


@dataclass
class Lexicon:
    """What every task needs of the counts: bounded by ``head`` words and ``classes`` sums."""

    shape: Shape
    total: int  # training tokens
    distinct: int
    hashes: np.ndarray  # sorted, of the frequent words
    counts: np.ndarray
    single: dict[int, int]  # word hash -> own class
    mass: np.ndarray  # tokens by class
    types: np.ndarray  # distinct words by class
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    @property
    def class_cost(self) -> np.ndarray:
        return np.log10(self.mass + SMOOTH * (self.types + 1))

    @property
    def bias(self) -> np.ndarray:
        x = np.log(self.mass + SMOOTH * (self.types + 1))
        return (x - x.max()).astype(np.float32)


def lexicon(counts: DataFrame, shape: Shape) -> Lexicon:
    """The frequent words, by a threshold found from the histogram of counts (at most 4,096
    numbers), and the sums by class."""
    steps = counts.groupBy(F.least("c", F.lit(4096)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    held, least = 0, 4097
    for r in sorted(steps, key=lambda r: -r["c"]):
        if held + r["n"] > shape.head:
            break
        held, least = held + r["n"], r["c"]
    head = counts.filter(F.col("c") >= least).toPandas().sort_values("h")
    top = head.sort_values(["c", "h"], ascending=[False, True]).head(shape.singles)
    single = {int(h): k for k, h in enumerate(top["h"])}
    sums = counts.groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toPandas()
    mass, types = np.zeros(shape.classes), np.zeros(shape.classes)
    mass[sums["cls"]], types[sums["cls"]] = sums["c"], sums["n"]
    for (h, cls, c), k in zip(top[["h", "cls", "c"]].itertuples(index=False), range(len(top)), strict=True):
        mass[cls] -= c
        types[cls] -= 1
        mass[k] += c
        types[k] += 1
    return Lexicon(shape, int(sums["c"].sum()), int(sums["n"].sum()), head["h"].to_numpy(np.int64), head["c"].to_numpy(np.int64), single, mass, types)


class Numbers(dict):
    """Word -> number in order of first sight; ``new`` lists the words not yet looked up."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Reader:
    """Texts to numpy: word numbers, hashes and classes by first letters, for one chunk."""

    def __init__(self, shape: Shape):
        self.letters = Letters(shape)
        self.reset()

    def reset(self) -> None:
        self.ids = Numbers()
        self.known: list[tuple[np.ndarray, np.ndarray]] = []

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts end to end, length of each)."""
        split = [tokens_of(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(split)), np.int32, int(sizes.sum()))
        if new := self.ids.new:
            letters = self.letters
            h = np.fromiter(map(word_hash, new), np.int64, len(new))
            self.known.append((h, np.fromiter((letters[w[:2] if w[:2].isascii() else w[:8]] for w in new), np.int32, len(new))))
            self.ids.new = []
        return numbers, sizes

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and class by first letters of each word, by number."""
        h, letter = (np.concatenate(x) for x in zip(*self.known, strict=True))
        return h, letter


@dataclass
class Words:
    """Hash, class and training count (-1: rare, to be asked for) of a chunk's words, by number."""

    hash: np.ndarray
    cls: np.ndarray
    count: np.ndarray

    @classmethod
    def known(cls, h: np.ndarray, letter: np.ndarray, lex: Lexicon) -> Words:
        single = np.array(sorted(lex.single), np.int64)
        kind, count = letter.astype(np.int64), np.full(len(h), -1, np.int64)
        if len(single):
            at = np.minimum(np.searchsorted(single, h), len(single) - 1)
            kind = np.where(single[at] == h, np.array([lex.single[x] for x in single.tolist()])[at], kind)
            at = np.minimum(np.searchsorted(lex.hashes, h), len(lex.hashes) - 1)
            count = np.where(lex.hashes[at] == h, lex.counts[at], count)
        return cls(h, kind, count)

    def rare(self) -> np.ndarray:
        """Numbers of the rare words, by hash."""
        found = np.flatnonzero(self.count < 0)
        return found[np.argsort(self.hash.view(np.uint64)[found])]


def back(h: np.ndarray, sizes: np.ndarray, steps: int) -> Iterator[np.ndarray]:
    """The hashes 1, 2, ... ``steps`` tokens back; 11 before the text."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for k in range(1, steps + 1):
        x = np.concatenate([np.full(min(k, len(h)), 11, np.uint64), h[: max(0, len(h) - k)]])
        x[place < k] = 11
        yield x


def features(h: np.ndarray, sizes: np.ndarray, shape: Shape) -> np.ndarray:
    """Row of each of the four features of each token; the types have no row in common."""
    shift = np.uint64(64 - int(np.log2(shape.buckets)))
    one, two, three = back(h, sizes, 3)
    salt = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    mix = ((one ^ (one >> np.uint64(31))) * salt[3]) ^ (two * salt[1] >> np.uint64(7))
    return np.stack([(x * c >> shift).astype(np.int64) * FEATURES + k for k, (x, c) in enumerate(zip((one, two, three, mix * salt[2]), salt, strict=True))], axis=1)


def class_energies(f: np.ndarray, weights: np.ndarray, bias: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Sums of the weights of tokens with feature rows ``f``, not normalised. The bias is at most 0
    and a weight grows as a quarter of a logarithm, so their exponentials are in a float's range."""
    x = np.take(weights, f[:, 0], axis=0, out=out, mode="clip")
    for k in range(1, f.shape[1]):
        x += np.take(weights, f[:, k], axis=0, mode="clip")
    x += bias
    return x


def class_scores(f: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Natural-log class probabilities of tokens with feature rows ``f``."""
    x = class_energies(f, weights, bias)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes (equal high bytes lie together), compressed."""
    parts = [len(arrays).to_bytes(4, "little")]
    for x in arrays:
        planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
        parts += [x.dtype.str.encode().ljust(4), len(x).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 4, []
    for _ in range(int.from_bytes(raw[:4], "little")):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 12).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 12 + n * kind.itemsize
    return out


@dataclass
class Pairs:
    """The distinct pairs of a chunk, in ascending order of their contexts (the word before and
    the class): ``per`` of each context, each with its word, and the pair of each token in ``own``."""

    context: np.ndarray
    per: np.ndarray
    word: np.ndarray
    of: np.ndarray
    own: np.ndarray

    @classmethod
    def of_tokens(cls, t: np.ndarray, sizes: np.ndarray, words: Words, lex: Lexicon) -> Pairs:
        own = np.flatnonzero(words.cls[t] >= lex.shape.singles)
        h = words.hash.view(np.uint64)
        one = next(back(h[t], sizes, 1))[own]
        w = t[own].astype(np.int64)
        mixed = (one ^ ((words.cls[w] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) >> np.uint64(64 - lex.shape.key_bits(lex.total))
        context, which = np.unique(mixed, return_inverse=True)
        pair, of = np.unique(which * len(h) + w, return_inverse=True)
        return cls(context, np.bincount(pair // len(h), minlength=len(context)), (h[pair % len(h)] >> np.uint64(40)).astype(np.uint32), of, own)


def slices(keys: np.ndarray, bits: int, of: int = 64) -> Iterator[tuple[int, int, int]]:
    """(range, begin, end) of ascending unsigned ``keys`` by the first ``bits`` of their ``of``."""
    if len(keys):
        at, first = np.unique(keys >> np.uint64(of - bits), return_index=True)
        yield from zip(at.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)


TEXT, PAIR, WORD, SUMS, ANSWER = range(5)
PASS = "kind int, at long, chunk long, data binary"
PART = 1 << 10  # rows of the class table that are summed together
BLOCK, SLICE = 1 << 13, 1 << 14  # tokens whose class probabilities are worked out, and summed, together


def _rows(kind: int, rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "at": [r[0] for r in rows], "chunk": [r[1] for r in rows], "data": [r[2] for r in rows]})


def _parts(table: np.ndarray, classes: int) -> pd.DataFrame:
    step = PART * classes
    return _rows(SUMS, [(i // step, 0, packed(table[i : i + step])) for i in range(0, len(table), step)])


def tokenised(rows: DataFrame, shape: Shape) -> DataFrame:
    """Rows (doc_id, text, learn) as chunks (kind TEXT): word numbers, lengths, ids, whether null
    and to learn from, and the hash and first letters' class of each word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, chunk, size = Reader(shape), TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pd.DataFrame:
            h, letter = reader.words()
            return _rows(TEXT, [(0, chunk, packed(*(np.concatenate(x) for x in zip(*held, strict=True)), h, letter))])

        for b in batches:
            for k in range(0, len(b), 300):
                part = b.iloc[k : k + 300]
                t, sizes = reader.read(part["text"].tolist())
                ids = part["doc_id"].astype("Int64")
                held.append((t, sizes, ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(bool), part["learn"].to_numpy(bool)))
                size += len(t)
                if size >= shape.chunk:
                    yield flush()
                    reader.reset()
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield flush()

    return rows.select("doc_id", "text", "learn").mapInPandas(run, PASS)


def class_counts(passed: DataFrame, lex: Lexicon) -> DataFrame:
    """Each task's counts of (feature row, class) over the training tokens (kind SUMS), by parts."""
    shared = passed.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        shape = lex.shape
        sums = np.zeros(FEATURES * shape.buckets * shape.classes, np.int64)
        for b in batches:
            for data in b["data"]:
                t, sizes, _, _, learn, h, letter = unpacked(data)
                own, cls = np.repeat(learn, sizes), Words.known(h, letter, lex).cls
                f = features(h.view(np.uint64)[t], sizes, shape)[own]
                np.add(sums, np.bincount((f * shape.classes + cls[t[own]][:, None]).ravel(), minlength=len(sums)), out=sums)
        if sums.any():
            yield _parts(sums, shape.classes)

    return passed.mapInPandas(run, PASS)


def asked(passed: DataFrame, lex: Lexicon) -> DataFrame:
    """The pairs (kind PAIR) and rarer words (WORD) of each chunk with their training counts
    there, by ranges of their hashes."""
    shared = passed.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        shape, bits, key_bits = lex.shape, lex.shape.range_bits(lex.total), lex.shape.key_bits(lex.total)
        for b in batches:
            for chunk, data in zip(b["chunk"].tolist(), b["data"], strict=True):
                t, sizes, _, _, learn, h, letter = unpacked(data)
                words, own = Words.known(h, letter, lex), np.repeat(learn, sizes)
                pairs = Pairs.of_tokens(t, sizes, words, lex)
                n = np.bincount(pairs.of[own[pairs.own]], minlength=len(pairs.word))
                ends = np.concatenate(([0], np.cumsum(pairs.per)))
                yield _rows(PAIR, [(r, chunk, packed(np.diff(pairs.context[a:e], prepend=np.uint64(0)), pairs.per[a:e], pairs.word[ends[a] : ends[e]], n[ends[a] : ends[e]])) for r, a, e in slices(pairs.context, bits, key_bits)])
                rare = words.rare()
                keys, n = h.view(np.uint64)[rare], np.bincount(t[own], minlength=len(h))[rare]
                yield _rows(WORD, [(r + (1 << bits), chunk, packed(np.diff(keys[a:e], prepend=np.uint64(0)), n[a:e])) for r, a, e in slices(keys, bits)])

    return passed.mapInPandas(run, PASS)


def summed_table(parts: DataFrame, lex: Lexicon) -> np.ndarray:
    """The class table that the tasks' SUMS rows add up to; its size hangs on the shape alone."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        return _rows(SUMS, [(int(df["at"].iloc[0]), 0, packed(sum(unpacked(x)[0].astype(float) for x in df["data"])))])

    table = np.zeros((FEATURES * lex.shape.buckets, lex.shape.classes))
    for r in parts.filter(F.col("kind") == SUMS).groupBy("at").applyInPandas(run, PASS).collect():
        x = unpacked(r["data"])[0].reshape(-1, lex.shape.classes)
        table[r["at"] * PART : r["at"] * PART + len(x)] = x
    return table


def _prior(lex: Lexicon) -> np.ndarray:
    q = np.exp(lex.bias.astype(float) - lex.bias.max())
    return lex.shape.prior * q / q.sum()


def train(passed: DataFrame, lex: Lexicon) -> Lexicon:
    """``lex`` with the weights of the class factor."""
    shape, prior = lex.shape, _prior(lex)
    seen = summed_table(class_counts(passed, lex), lex)
    weights = np.log1p(seen / prior) / FEATURES
    weights -= weights.min(axis=1, keepdims=True)  # what all classes of a row share cancels
    lex.weights = weights.astype(np.float32)
    for _ in range(shape.rounds):
        shared = passed.sparkSession.sparkContext.broadcast(lex)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            lex = shared.value
            shape, bias = lex.shape, lex.bias
            table = np.zeros((FEATURES, shape.classes, shape.buckets))
            for b in batches:
                for data in b["data"]:
                    t, sizes, _, _, learn, h, _ = unpacked(data)
                    f = features(h.view(np.uint64)[t], sizes, shape)[np.repeat(learn, sizes)]
                    for s in range(0, len(f), SLICE):
                        part, columns = f[s : s + SLICE], np.empty((shape.classes, len(f[s : s + SLICE])))
                        for i in range(0, len(part), BLOCK):
                            x = class_energies(part[i : i + BLOCK], lex.weights, bias)
                            np.exp(x, out=x)
                            x /= x.sum(axis=1, keepdims=True)
                            columns[:, i : i + BLOCK] = x.T
                        for k in range(FEATURES):
                            bucket = part[:, k] // FEATURES
                            for c in range(shape.classes):
                                table[k, c] += np.bincount(bucket, weights=columns[c], minlength=shape.buckets)
            # 16 bits of each mantissa are enough for a sum over tasks; the lowest byte plane is empty.
            cut = table.transpose(2, 0, 1).astype(np.float32).ravel().view(np.uint32)
            if cut.any():
                yield _parts(((cut + np.uint32(128)) & np.uint32(0xFFFFFF00)).view(np.float32), shape.classes)

        expected = summed_table(passed.mapInPandas(run, PASS), lex)
        lex = replace(lex, weights=lex.weights + (np.log((seen + prior) / (expected + prior)) / FEATURES).astype(np.float32))
    return lex


def answers(passed: DataFrame, lex: Lexicon) -> DataFrame:
    """The summed counts that each chunk asked a range for (kind ANSWER): of each pair, and of
    each context; or of each rarer word."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        got = [unpacked(x) for x in df["data"]]
        out = []
        if df["kind"].iloc[0] == WORD:
            got = [(np.cumsum(c), n) for c, n in got]
            keys, which = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate([x[1] for x in got])).astype(np.int64)[which]
            ends = np.cumsum([len(x[0]) for x in got])[:-1]
            out = [packed(x) for x in np.split(total, ends)]
        else:
            got = [(np.cumsum(c), m, w, n) for c, m, w, n in got]
            context, word, n = (np.concatenate(x) for x in ([np.repeat(c, m) for c, m, _, _ in got], [x[2] for x in got], [x[3] for x in got]))
            key = (context ^ (word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
            _, which = np.unique(key ^ (key >> np.uint64(29)), return_inverse=True)
            pair = np.bincount(which, weights=n).astype(np.int64)[which]
            names, which = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
            lengths = np.concatenate([x[1] for x in got])
            whole = np.bincount(np.repeat(which, lengths), weights=n, minlength=len(names)).astype(np.int64)[which]
            out = [packed(a, b) for a, b in zip(np.split(pair, np.cumsum([len(x[2]) for x in got])[:-1]), np.split(whole, np.cumsum([len(x[0]) for x in got])[:-1]), strict=True)]
        return _rows(ANSWER, list(zip(df["at"].tolist(), df["chunk"].tolist(), out, strict=True)))

    return asked(passed, lex).groupBy("at").applyInPandas(run, PASS)


def token_scores(t: np.ndarray, sizes: np.ndarray, words: Words, pairs: Pairs, pair: np.ndarray, context: np.ndarray, lex: Lexicon) -> np.ndarray:
    """log10 p of each token of a chunk, given the counts of its pairs and contexts."""
    shape, bias, cls = lex.shape, lex.bias, words.cls[t]
    out = np.empty(len(t))
    f = features(words.hash.view(np.uint64)[t], sizes, shape)
    for s in range(0, len(t), BLOCK):
        x = class_energies(f[s : s + BLOCK], lex.weights, bias)
        out[s : s + len(x)] = x[np.arange(len(x)), cls[s : s + len(x)]] - np.log(np.exp(x, out=x).sum(axis=1))
    share = (words.count[t] + SMOOTH) / 10 ** lex.class_cost[cls]
    whole = np.repeat(context, pairs.per)[pairs.of]
    share[pairs.own] = (shape.kappa * share[pairs.own] + pair[pairs.of]) / (shape.kappa + whole)
    return out / np.log(10) + np.log10(share)


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row (doc_id, text, learn), with
    weights from those to learn from."""
    return chunk_scores(written(tokenised(docs, lex.shape), "tokens"), lex)


def chunk_scores(passed: DataFrame, lex: Lexicon) -> DataFrame:
    """As ``score_texts``, for the chunks of ``tokenised``."""
    lex = train(passed, lex)
    shared = passed.sparkSession.sparkContext.broadcast(lex)
    base_cost = float(np.log10(lex.total + SMOOTH * (lex.distinct + 1)))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        lex = shared.value
        bits = lex.shape.range_bits(lex.total)
        t, sizes, ids, null, _, h, letter = unpacked(df["data"][df["kind"] == TEXT].iloc[0])
        words = Words.known(h, letter, lex)
        found = df[df["kind"] == ANSWER].sort_values("at")
        got = [unpacked(x)[0] for x in found["data"][found["at"] >= 1 << bits]]
        words.count[words.rare()] = np.concatenate(got) if got else 0
        got = [unpacked(x) for x in found["data"][found["at"] < 1 << bits]]
        pair, context = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64), np.empty(0, np.int64))
        got = token_scores(t, sizes, words, Pairs.of_tokens(t, sizes, words, lex), pair, context, lex)
        first = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, first)
        c = words.count[t]
        return pd.DataFrame({"doc_id": pd.array(np.where(null, None, ids), "Int64"), "n_tokens": sizes, "n_known": add((c > 0).astype(np.int64)), "base_score": add(np.log10(c + SMOOTH)) - sizes * base_cost, "score": add(got)})

    chunks = passed.unionByName(answers(passed, lex))
    return chunks.groupBy("chunk").applyInPandas(run, SCORED)


def lm_scores(docs: DataFrame, shape: Shape = Shape(), folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents whose crc32(id as text) mod ``folds`` is not 0; score all."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    passed = written(tokenised(rows.withColumn("learn", F.col("doc_id").isNotNull() & ~held), shape), "tokens")
    counts = written(counts_of(passed), "counts")
    lex = lexicon(counts, shape)
    drop_written(counts)
    lex.shape = shape.sized(lex.total)
    scored = chunk_scores(passed, lex)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), "base_score", "score")
