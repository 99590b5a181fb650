"""Operator 2 - token ids in bit-plane files.

Documents are dealt by ranges of doc_id, encoded, and packed into files of about ``file_ids``
ids; a file holds whole documents. Layout of one file (all numbers little-endian):

    header   8s magic, u32 version, u32 block size, u32 planes (32 bits or 4 bytes), u64 ids, u32 documents, u32 blocks
    documents  i64 doc_id (null: smallest), u8 is-null, u32 ids
    index    for each block: u64 offset of its first plane, then u32 compressed length per plane
    planes   each plane of each block as one zstandard frame; a plane of zeros has length 0

A block is ``block`` consecutive ids turned into planes: plane j holds bit j (or byte j) of
every id, so equal high bits lie together and compress well. The index gives any block without
reading the others. Files are rows of a Parquet dataset (shard, part, payload): Spark's output
commit keeps them whole when an executor is lost, on any store.

Defined results: a null text is an empty one; every document gets at least the end id; a null
doc_id sorts first; rows of one doc_id stay together in no particular order; extra columns are
ignored; an empty table makes no file.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAGIC = b"BITPLANE"
BLANK = "\u0120"  # how a byte-level vocabulary writes a blank
HEAD = struct.Struct("<8sIIIQII")


@dataclass(frozen=True)
class Format:
    block: int = 1 << 16
    file_ids: int = 1 << 20
    planes: str = "byte"  # or "bit"
    level: int = 3


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of up to one block of unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    out = []
    for k in range(4):
        bits = np.unpackbits(np.ascontiguousarray(raw[:, k])[:, None], axis=1, bitorder="little")
        out += [np.packbits(bits[:, j], bitorder="little").tobytes() for j in range(8)]
    return out


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, x in enumerate(planes):
            raw[:, k] = np.frombuffer(x, np.uint8) if x else 0
    else:
        for j, x in enumerate(planes):
            if x:
                raw[:, j // 8] |= np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little") << (j % 8)
    return raw.view("<u4").ravel()


def pack(docs: list[tuple[int | None, np.ndarray]], fmt: Format = Format()) -> bytes:
    """One file of whole documents."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.empty(0, np.uint32)
    squeeze = zstandard.ZstdCompressor(level=fmt.level).compress
    count = 32 if fmt.planes == "bit" else 4
    blocks = -(-len(ids) // fmt.block)
    names = np.array([-(1 << 63) if d is None else d for d, _ in docs], "<i8").tobytes() + bytes(d is None for d, _ in docs)
    table = np.array([len(x) for _, x in docs], "<u4").tobytes()
    head = HEAD.pack(MAGIC, 1, fmt.block, count, len(ids), len(docs), blocks)
    index, body = [], []
    at = len(head) + len(names) + len(table) + blocks * (8 + 4 * count)
    for b in range(blocks):
        parts = [squeeze(x) if any(x) else b"" for x in planes_of(ids[b * fmt.block : (b + 1) * fmt.block], fmt.planes)]
        index.append(struct.pack(f"<Q{count}I", at, *map(len, parts)))
        body += parts
        at += sum(map(len, parts))
    return b"".join([head, names, table, *index, *body])


def read_block(data: bytes, b: int) -> np.ndarray:
    """The ids of block ``b``, found by the chunk index."""
    magic, version, block, count, n, n_docs, _ = HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a bit-plane file")
    at, *sizes = struct.unpack_from(f"<Q{count}I", data, HEAD.size + 13 * n_docs + b * (8 + 4 * count))
    grow, parts, view = zstandard.ZstdDecompressor().decompress, [], memoryview(data)
    for s in sizes:
        parts.append(grow(view[at : at + s]) if s else b"")
        at += s
    return ids_of(parts, min(block, n - b * block), "bit" if count == 32 else "byte")


def unpack(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    _, _, _, _, n, n_docs, blocks = HEAD.unpack_from(data)
    names = np.frombuffer(data, "<i8", n_docs, HEAD.size)
    null = np.frombuffer(data, np.uint8, n_docs, HEAD.size + 8 * n_docs)
    sizes = np.frombuffer(data, "<u4", n_docs, HEAD.size + 9 * n_docs)
    ids = np.concatenate([read_block(data, b) for b in range(blocks)]) if blocks else np.empty(0, np.uint32)
    cut = np.split(ids, np.cumsum(sizes)[:-1]) if n_docs else []
    return [(None if z else int(d), x) for d, z, x in zip(names, null, cut, strict=True)]


class Encoder:
    """The tokenizers library behind a word cache.

    Byte-level pre-tokens never reach over a single blank or line break between two other
    characters, other than to start with it, nor over the end of a run of letters that no digit
    follows (the class here also holds a few odd numerals, hence the digits): such a text may be
    encoded piece by piece. Texts with other white space, or with the text of a special token,
    go to the library whole."""

    PIECE = re.compile(r"[ \n]?[^\W\d_]++(?!\d)|[ \n]?\S+")
    ROOM = 700_000  # pieces kept

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core already
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        vocabulary = self.own.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith(BLANK)]] = True
        self.seen: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        cut: list[list[str] | None] = []
        for t in texts:
            parts = self.PIECE.findall(t)
            safe = sum(map(len, parts)) == len(t) and not any(s in t for s in self.special)
            cut.append(parts if safe else None)
        if len(self.seen) > self.ROOM:
            self.seen.clear()
        new = list(set().union(*(parts for parts in cut if parts)).difference(self.seen))
        # Pieces with a leading blank are encoded many at a time, end to end: just the first token
        # of each begins with the blank.
        blank = [p for p in new if p[0] == " "]
        runs = [blank[k : k + 500] for k in range(0, len(blank), 500)]
        alone = [p for p in new if p[0] != " "]
        for run, e in zip(runs, self._encoded(["".join(r) for r in runs]), strict=True):
            first = np.append(np.flatnonzero(self.leads[e]), len(e)) * 4
            if len(first) != len(run) + 1:
                alone += run
                continue
            raw = e.tobytes()
            self.seen.update(zip(run, [raw[i:j] for i, j in itertools.pairwise(first.tolist())], strict=True))
        for k in range(0, len(alone), 4_000):  # encodings are large objects: few at a time
            some = alone[k : k + 4_000]
            self.seen.update(zip(some, [e.tobytes() for e in self._encoded(some)], strict=True))
        whole = [t for t, parts in zip(texts, cut, strict=True) if parts is None]
        rest = iter(self.own.encode_batch_fast(whole, add_special_tokens=False)) if whole else iter(())
        get = self.seen.__getitem__
        out = []
        for parts in cut:
            if parts is None:
                out.append(np.array(next(rest).ids, np.uint32))
            else:
                out.append(np.frombuffer(b"".join(map(get, parts)), "<u4"))
        return out


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One encoder a Python worker: its words outlive a task."""
    return Encoder(path)


FILES = "shard int, part int, docs long, ids long, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shards: int | None = None, fmt: Format = Format(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the files of ``docs`` in ascending doc_id order (by shard, part, place in it)."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = texts.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # the cache holds no cycles
        encoder, shard, part = worker_encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0
        end = np.array([end_id], np.uint32)

        def file() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "part": [part], "docs": [len(held)], "ids": [size], "payload": [pack(held, fmt)]})

        for b in batches:
            names = [None if pd.isna(x) else int(x) for x in b["doc_id"]]
            texts = b["text"].tolist()
            for k in range(0, len(texts), 200):
                for name, ids in zip(names[k : k + 200], encoder.ids(texts[k : k + 200]), strict=True):
                    held.append((name, np.append(ids, end)))
                    size += len(held[-1][1])
                    if size >= fmt.file_ids:
                        yield file()
                        held, size, part = [], 0, part + 1
        if held:
            yield file()
        gc.freeze()  # what stays is not scanned again
        gc.enable()

    dealt.mapInPandas(run, FILES).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, part) of every document in the files; start
    is the number of ids before it. Positions come from the files' counts alone: one sum a
    shard, then one a file."""
    files = spark.read.schema(FILES).parquet(path)
    counts = files.select("shard", "part", "ids")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = counts.groupBy("shard").agg(F.sum("ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("file_start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, part, data in zip(b["shard"], b["part"], b["payload"], strict=True):
                docs = unpack(data)
                sizes = np.array([len(x) for _, x in docs], np.int64)
                crc = [zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for _, x in docs]
                yield pd.DataFrame({"shard": shard, "part": part, "doc_id": pd.array([d for d, _ in docs], "Int64"), "place": np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids_crc32": crc})

    rows = files.select("shard", "part", "payload").mapInPandas(run, "shard int, part int, doc_id long, place long, n_tokens long, ids_crc32 long")
    offsets = starts.join(shards, "shard").select("shard", "part", (F.col("shard_start") + F.col("file_start")).alias("first"))
    return rows.join(offsets, ["shard", "part"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "shard", "part")
