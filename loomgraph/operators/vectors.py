"""Embeddings, cosine search and similar pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import plain
from ..sources.corpus import append_cache
from ..sources.scratch import written
from .cells import best_places, cell_pairs

PLACES = 4  # scores are rounded before they are ranked or compared
QUERY_BLOCK = 8192  # query vectors broadcast at a time
TOP_BLOCK = 8192  # the same for the top k
COLUMNS = 1024  # of them with a batch of items at a time
BLOCK_ROWS = 8192  # of a block of vectors paired with another


def hash_vectors(texts: list[str | None], dims: int = 64) -> list[list[float]]:
    """The offline model: signed feature hashing of 3-grams, unit length. Same as ``hash_embed``. A gram
    is hashed once a process; the table is begun anew when it holds too many."""
    key = dims, _Grams.BITS
    if key not in _tables or len(_tables[key].others) > 1 << max(16, _Grams.BITS):
        _tables[key] = _Grams(dims)
    return _tables[key].vectors([(t or "").lower() for t in texts]).tolist() if len(texts) else []


def embed(df: DataFrame, text_col: str, embed_fn=hash_vectors, dims: int = 64, batch: int = 64) -> DataFrame:
    """``df`` plus ``embedding``: newlines become blanks, texts are trimmed; an empty text gives a
    zero vector; if a batch fails its texts are tried one by one, and a failing text gives an
    empty vector."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", embedding array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [(t or "").replace("\n", " ").strip() for t in b[text_col]]
            done: list[list[float]] = []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                try:
                    got = [list(map(float, v)) for v in embed_fn([t or " " for t in part])]
                except Exception:  # noqa: BLE001 - any failure of the injected function
                    got = []
                    for one in part:
                        try:
                            got.append(list(map(float, embed_fn([one or " "])[0])))
                        except Exception:  # noqa: BLE001
                            got.append([])
                done += [v if t else [0.0] * dims for t, v in zip(part, got, strict=True)]
            yield plain(b).assign(embedding=done)

    return df.mapInPandas(run, fields)


class _Grams:
    """Numbers of 3-grams, and what each adds to which dimension. A gram's number is its slot in a
    table, found for whole arrays at once; one whose slot is taken has a number past the table."""

    BITS = 20

    def __init__(self, dims: int):
        self.dims, self.bits = dims, self.BITS
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.dim, self.sign = np.zeros(1 << self.BITS, np.int64), np.zeros(1 << self.BITS)
        self.others: dict[int, int] = {}

    def _put(self, n: int, key: int) -> None:
        from hashlib import md5

        codes = [key >> shift & 0x1FFFFF for shift in (42, 21, 0)]
        d = md5("".join(chr(c - 1) for c in codes if c).encode("utf-8", "replace")).digest()
        self.dim[n], self.sign[n] = d[0] % self.dims, 1.0 if d[1] % 2 == 0 else -1.0

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != keys)
        if len(missing):
            new, which = np.unique(keys[missing], return_inverse=True)
            at = slot[missing[np.unique(which, return_index=True)[1]]]
            found = []
            for key, n in zip(new.tolist(), at.tolist(), strict=True):
                if self.keys[n] == 0:
                    self.keys[n] = key
                    self._put(n, key)
                elif self.keys[n] != key:
                    if key not in self.others:
                        n = self.others[key] = (1 << self.bits) + len(self.others)
                        if n >= len(self.dim):
                            self.dim, self.sign = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.dim, self.sign))
                        self._put(n, key)
                    n = self.others[key]
                found.append(n)
            slot[missing] = np.array(found)[which]
        return slot

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of lower-case texts: distinct grams of each, summed by dimension."""
        chars = [np.frombuffer(t.encode("utf-32-le", "replace"), "<u4") for t in texts]
        sizes = np.fromiter(map(len, chars), np.int64, len(chars))
        c = np.concatenate([*chars, np.zeros(2, "<u4")]).astype(np.uint64) + np.uint64(1)  # 0 is no character
        ends = np.cumsum(sizes)
        key = c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
        own, place = np.repeat(np.arange(len(texts)), sizes), np.arange(len(key))
        left = ends[own] - place
        # a text of one or two characters is its own gram
        short = np.isin(own, np.flatnonzero(sizes < 3)) & (left == sizes[own])
        key = np.where(left > 2, key, np.where(left == 2, key & ~np.uint64(0x1FFFFF), c[:-2] << np.uint64(42)))
        used = (left > 2) | short
        own, n = own[used], self.numbers(key[used])
        pair = np.sort(own * (1 << 40) + n)
        pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(pair) else pair
        own, n = pair >> 40, pair & ((1 << 40) - 1)
        v = np.bincount(own * self.dims + self.dim[n], weights=self.sign[n], minlength=len(texts) * self.dims).astype(float).reshape(len(texts), self.dims)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.divide(v, norm, out=v, where=norm > 0)


_tables: dict[tuple[int, int], _Grams] = {}  # of this process


def hash_vector(text: Column, dims: int = 64) -> Column:
    """The offline model as a column: distinct lower-case 3-grams, md5 byte 0 picks the dimension, the
    parity of byte 1 the sign; scaled to unit length. Null is an empty text. Narrow: texts are
    taken by the batch, and a gram is hashed once a task."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = _Grams(dims)
        for b in batches:
            texts, out, first = b.to_pylist(), [], 0
            ends = np.cumsum([len(t) for t in texts])
            while first < len(texts):  # some 262,144 characters at a time
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 18), "right")))
                out.append(grams.vectors(texts[first:last]))
                first = last
            flat = np.concatenate(out).ravel() if out else np.empty(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dims, pa.int32()), pa.array(flat))

    # not to be run again where a filter on the vector is pushed down
    return run.asNondeterministic()(F.lower(F.coalesce(text, F.lit(""))))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """(id, embedding) by ``hash_vector``."""
    return df.select(id_col, hash_vector(F.col(text_col), dims).alias("embedding"))


def _unit(rows: list) -> np.ndarray:
    sizes = [0 if r is None else len(r) for r in rows]
    width = max(sizes, default=0)
    if width and min(sizes) == width and all(isinstance(r, np.ndarray) for r in rows):
        out = np.concatenate(rows).astype(float, copy=False).reshape(-1, width)
    else:
        out = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            if sizes[i] == width and width:
                out[i] = np.asarray(r, dtype=float)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _items_with_skips(items: DataFrame, skip: DataFrame | None) -> DataFrame:
    """Items with vectors, and with the queries (null: none) that must not find them."""
    rows = items.select("item_id", "embedding").filter(F.size("embedding") > 0)
    if skip is None:
        return rows.withColumn("skips", F.lit(None).cast("array<string>"))
    return rows.join(skip.select("q_id", "item_id").groupBy("item_id").agg(F.collect_set("q_id").alias("skips")), "item_id", "left")


def _hide(score: np.ndarray, skips: list, at: dict, first: int = 0) -> None:
    """Scores of (item, query) pairs to be left out, below any cosine; columns begin with query ``first``."""
    for i, names in enumerate(skips):
        if names is not None and len(names):
            places = (at[q] - first for q in names if q in at)
            score[i, [j for j in places if 0 <= j < score.shape[1]]] = -9.0


def vector_topk(queries: DataFrame, items: DataFrame, k: int = 5, exclude_self: bool = False, skip: DataFrame | None = None) -> DataFrame:
    """(q_id, item_id, score, rank): the k best items of each query by cosine, ties by item; pairs in
    ``skip`` (q_id, item_id) are left out where they are scored, so none of them takes a place.

    Queries are taken in blocks of a stated size, each broadcast against all items; every task
    keeps its own k best a query, so only those are shuffled."""
    spark = queries.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // TOP_BLOCK))
    kinds = {f.name: f.dataType.simpleString() for f in items.schema} | {f"q_{f.name}": f.dataType.simpleString() for f in queries.schema}
    schema = f"q_id {kinds['q_q_id']}, item_id {kinds['item_id']}, score double"
    rows = _items_with_skips(items, skip)
    found: DataFrame | None = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        shared = spark.sparkContext.broadcast([(r["q_id"], list(r["embedding"] or [])) for r in part.select("q_id", "embedding").collect()])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names = np.array([q for q, _ in shared.value], dtype=object)
            q = _unit([v for _, v in shared.value])
            at = {x: j for j, x in enumerate(names.tolist())}
            least, rooms = np.full(len(names), -1.5), np.full(len(names), k)
            slack = 0.5 * 10**-PLACES + 2e-7 * q.shape[1] + 1e-6  # of rounding, and of single precision
            short = [np.ascontiguousarray(q[c : c + COLUMNS].T, np.float32) for c in range(0, len(q), COLUMNS)]
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            limit = max(20_000, 4 * k * len(names))

            def packed() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                of, dst, score = (np.concatenate(x) for x in zip(*held, strict=True))
                kept = best_places(of, rooms, dst, score)
                of, dst, score = of[kept], dst[kept], score[kept]
                worst = np.full(len(names), np.inf)
                np.minimum.at(worst, of, score)
                full = np.bincount(of, minlength=len(names)) >= k
                least[full] = worst[full]
                return [(of, dst, score)]

            for batch in batches:
                for s in range(0, len(batch), 1024):
                    b = batch.iloc[s : s + 1024]
                    ids, v = b["item_id"].to_numpy(dtype=object), _unit(b["embedding"].tolist())
                    if not len(names) or v.shape[1] != q.shape[1]:
                        continue
                    skips, low = b["skips"].tolist(), v.astype(np.float32)
                    hidden = exclude_self or any(x is not None and len(x) for x in skips)
                    # All pairs in single precision; those that may count are scored in full.
                    for c, part in enumerate(short):
                        near, first = low @ part, c * COLUMNS
                        if hidden:
                            _hide(near, skips, at, first)
                            if exclude_self:
                                _hide(near, [[x] for x in ids], at, first)
                        bound = least[first : first + COLUMNS] - slack
                        new = np.flatnonzero(bound < -1.1)  # queries without k items so far: this batch's own k-th
                        if len(new) and len(near) > k:
                            some = near if len(new) == near.shape[1] else near[:, new]
                            bound[new] = np.maximum(-2.0, np.partition(some, len(near) - k, axis=0)[len(near) - k] - 2 * slack)
                        i, j = np.nonzero(near >= np.maximum(bound, -2.0).astype(np.float32))
                        if not len(i):
                            continue
                        score = np.round(np.einsum("ik,ik->i", v[i], q[first + j]), PLACES)
                        kept = score >= least[first + j]
                        held.append((first + j[kept], ids[i[kept]], score[kept]))
                    if sum(len(x[0]) for x in held) > limit:
                        held[:] = packed()
            if held:
                of, dst, score = packed()[0]
                yield plain(pd.DataFrame({"q_id": names[of], "item_id": dst, "score": score}))

        part_found = rows.mapInPandas(run, schema)
        found = part_found if found is None else found.unionByName(part_found)
    best = W.partitionBy("q_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def best_queries(queries: DataFrame, items: DataFrame, k: int, threshold: float, skip: DataFrame | None = None) -> DataFrame:
    """(item_id, q_id, score): the k best queries of each item at the threshold or above, ties by
    query; pairs in ``skip`` (q_id, item_id) are left out where they are scored. Queries are
    broadcast in blocks of a stated size; an item is scored where it lies and sends k rows a
    block at most."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    kinds = items.schema["item_id"].dataType.simpleString(), queries.schema["q_id"].dataType.simpleString()
    rows = _items_with_skips(items, skip)
    found: DataFrame | None = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        known = sorted((r["q_id"], list(r["embedding"])) for r in part.select("q_id", "embedding").filter(F.size("embedding") > 0).collect())
        shared = queries.sparkSession.sparkContext.broadcast(([q for q, _ in known], _unit([v for _, v in known])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = np.array(shared.value[0], dtype=object), shared.value[1]
            at = {x: j for j, x in enumerate(names.tolist())}
            slack = 0.5 * 10**-PLACES + 2e-7 * q.shape[1] + 1e-6  # of rounding, and of single precision
            short = [np.ascontiguousarray(q[c : c + COLUMNS].T, np.float32) for c in range(0, len(q), COLUMNS)]
            for b in (whole.iloc[s : s + 1024] for whole in batches for s in range(0, len(whole), 1024)):
                v = _unit(b["embedding"].tolist())
                if not len(names) or v.shape[1] != q.shape[1]:
                    continue
                # All pairs in single precision; those that may count are scored in full.
                skips, low, bound, held = b["skips"].tolist(), v.astype(np.float32), np.full(len(v), max(threshold, -2.0)), []
                for c, part in enumerate(short):
                    near = low @ part
                    if any(x is not None and len(x) for x in skips):
                        _hide(near, skips, at, c * COLUMNS)
                    i, j = np.nonzero(near >= np.float32(bound.min() - slack))
                    if len(i) * 16 > near.size and near.shape[1] > k:
                        bound = np.maximum(bound, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - slack)
                    few = near[i, j] >= bound[i] - slack
                    i, j = i[few], j[few] + c * COLUMNS
                    held.append((i, j, np.round(np.einsum("ik,ik->i", v[i], q[j]), PLACES)))
                i, j, score = (np.concatenate(x) for x in zip(*held, strict=True))
                few = (score >= threshold) & (score > -2)
                i, j, score = i[few], j[few], score[few]
                few = best_places(i, np.full(len(v), k), j, score)  # names are in order: so are ties
                yield plain(pd.DataFrame({"item_id": b["item_id"].to_numpy(dtype=object)[i[few]], "q_id": names[j[few]], "score": score[few]}))

        part_found = rows.mapInPandas(run, f"item_id {kinds[0]}, q_id {kinds[1]}, score double")
        found = part_found if found is None else found.unionByName(part_found)
    best = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("q_id"))
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def cached_embed(sections: DataFrame, cache: DataFrame, embed_fn=hash_vectors, dims: int = 64, cache_path: str | None = None, model: str = "hash") -> DataFrame:
    """``sections`` plus ``embedding``: known hashes from ``cache``, each missing hash embedded once."""
    missing = sections.select("content_hash", "text").dropDuplicates(["content_hash"]).join(cache.select("content_hash"), "content_hash", "left_anti")
    fresh = embed(missing, "text", embed_fn, dims).select("content_hash", "embedding")
    if cache_path:
        append_cache(fresh, cache_path, model, dims)
    known = cache.select("content_hash", "embedding").unionByName(fresh)
    return sections.join(known, "content_hash", "left")


def _block_pairs(items: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """(src, dst, score) at or above the threshold, both directions: rows are dealt to the pairs
    of blocks they belong to, and each pair is one matrix product."""
    own = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("own")
    dealt = items.filter(F.size("embedding") > 0).select("item_id", "embedding", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("pair", F.least("own", "other") * blocks + F.greatest("own", "other"))
    kind = items.schema["item_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = divmod(int(rows["pair"].iloc[0]), blocks)
        left, right = rows[rows["own"] == a], rows[rows["own"] == b]
        out = []
        x, y = _unit(left["embedding"].tolist()), _unit(right["embedding"].tolist())
        if len(left) and len(right) and x.shape[1] == y.shape[1]:
            p, q = left["item_id"].to_numpy(), right["item_id"].to_numpy()
            for s in range(0, len(p), 1024):
                score = np.round(x[s : s + 1024] @ y.T, PLACES)
                i, j = np.nonzero(score >= threshold)
                keep = (p[s + i] < q[j]) if a == b else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                out.append(pd.DataFrame({"src": p[s + i], "dst": q[j], "score": score[i, j]}))
                out.append(pd.DataFrame({"src": q[j], "dst": p[s + i], "score": score[i, j]}))
        return plain(pd.concat(out)) if out else pd.DataFrame({"src": [], "dst": [], "score": []}, dtype=object)

    return dealt.groupBy("pair").applyInPandas(run, f"src {kind}, dst {kind}, score double")


def _lsh_pairs(items: DataFrame, threshold: float, tables: int = 12, width: float = 0.35, seed: int = 5) -> DataFrame:
    """The same pairs, found by random projections of unit vectors and checked exactly: linear in
    the rows, with a recall that grows with ``tables``."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = items.filter(F.size("embedding") > 0).select("item_id", array_to_vector("embedding").alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="v").transform(rows)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-3
    near = model.approxSimilarityJoin(unit, unit, far, "d").filter("datasetA.item_id <> datasetB.item_id")
    a, b = vector_to_array("datasetA.v"), vector_to_array("datasetB.v")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return near.select(F.col("datasetA.item_id").alias("src"), F.col("datasetB.item_id").alias("dst"), F.round(dot, PLACES).alias("score")).filter(F.col("score") >= threshold)


def _blocks(items: DataFrame) -> int:
    """Blocks of at most about BLOCK_ROWS rows, so that what a task holds does not grow."""
    return max(8, -(-items.count() // BLOCK_ROWS))


def similar_pairs(items: DataFrame, threshold: float = 0.7, max_per_item: int | None = 3, exclude: DataFrame | None = None, method: str = "exact", blocks: int | None = None) -> DataFrame:
    """(src, dst, score): up to ``max_per_item`` most similar others of each item, best first with
    ties by dst; pairs in ``exclude`` (src, dst) are skipped in either direction. ``cells`` and
    ``exact`` give the same rows: the first partitions by cells, keeps the best inside its tasks and
    is the form for large tables; the second deals rows to pairs of blocks (work rows x blocks) and
    sends every pair. ``lsh`` is linear and misses some. ``blocks`` (of ``exact``) follows from the
    number of rows if it is not given.

    With a ``max_per_item``, only the first item of each group of equal vectors is paired; of a
    group that is near, an item takes as many of the first members as could be among its best."""
    if exclude is not None:
        both = exclude.select("src", "dst").unionByName(exclude.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    if max_per_item is None:
        found = items.filter(F.size("embedding") > 0)
        if method == "cells":
            return cell_pairs(found.select("item_id", "embedding", F.lit(None).cast("int").alias("room")), threshold, None if exclude is None else exclude)
        pairs = _block_pairs(items, threshold, blocks or _blocks(items)) if method == "exact" else _lsh_pairs(items, threshold)
        return pairs if exclude is None else pairs.join(both, ["src", "dst"], "left_anti")
    rows = items.filter(F.size("embedding") > 0).select("item_id", "embedding", F.xxhash64("embedding").alias("h"))
    if method == "cells":  # read several times: vectors are made once
        rows = written(rows, "vectors")
    firsts = rows.groupBy("h", "embedding").agg(F.min("item_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    room = max_per_item + 1  # the item itself may be among the first
    if method == "cells":
        both = None if exclude is None else written(both, "left-out")
        firsts = written(firsts, "first-vectors")
    known = rows.join(firsts, ["h", "embedding"]).select("item_id", "rep", "size")
    if method == "cells":
        known = written(known, "equal-vectors")
        near = written(_near_groups(firsts, known, threshold, max_per_item, None if exclude is None else both), "near")
    else:
        asked = firsts.select(F.col("rep").alias("item_id"), "embedding")
        near = _block_pairs(asked, threshold, blocks or _blocks(asked)) if method == "exact" else _lsh_pairs(asked, threshold)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    own = firsts.select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.when(squares > 0, 1.0).otherwise(0.0).alias("score")).filter(F.col("score") >= threshold)
    near = near.unionByName(own)
    pairs = known.select(F.col("item_id").alias("src"), "rep").join(near.select(F.col("src").alias("rep"), F.col("dst").alias("group"), "score"), "rep").drop("rep")
    place = F.row_number().over(W.partitionBy("rep").orderBy("item_id"))
    few = known.withColumn("place", place).filter(F.col("place") <= room).select(F.col("rep").alias("group"), F.col("item_id").alias("dst"))
    if exclude is None:
        pairs = pairs.join(few, "group").filter("src <> dst").select("src", "dst", "score")
    else:
        members = known.select(F.col("rep").alias("group"), F.col("item_id").alias("dst"))
        skipped = both.join(members, "dst").groupBy("src", "group").agg(F.count(F.lit(1)).alias("skipped"))
        pairs = pairs.join(skipped, ["src", "group"], "left")
        plenty = pairs.filter("skipped IS NULL").join(few, "group")
        placed = members.join(skipped.select("group").distinct(), "group").withColumn("place", F.row_number().over(W.partitionBy("group").orderBy("dst")))
        more = pairs.filter("skipped IS NOT NULL").join(placed, "group").filter(F.col("place") <= F.col("skipped") + room)
        pairs = plenty.drop("skipped").unionByName(more.drop("skipped", "place")).filter("src <> dst").select("src", "dst", "score").join(both, ["src", "dst"], "left_anti")
    best = W.partitionBy("src").orderBy(F.col("score").desc(), F.col("dst"))
    return pairs.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= max_per_item).drop("n")


def _near_groups(firsts: DataFrame, known: DataFrame, threshold: float, k: int, both: DataFrame | None) -> DataFrame:
    """(src, dst, score) of first members: the best ``k`` groups of each, and one more for each
    group with copies that some member's pairs to leave out touch. Where neither side has copies
    such a pair is left out inside the task, so a name with many links keeps ``k`` all the same."""
    asked = firsts.select(F.col("rep").alias("item_id"), "embedding", F.lit(k).alias("room"))
    if both is None:
        return cell_pairs(asked, threshold)
    of = lambda name: known.select(F.col("item_id").alias(name), F.col("rep").alias(f"{name}_rep"), F.col("size").alias(f"{name}_n"))
    met = both.join(of("src"), "src").join(of("dst"), "dst")
    single = (F.col("src_n") == 1) & (F.col("dst_n") == 1)
    more = met.filter(~single).groupBy(F.col("src_rep").alias("item_id")).agg(F.count_distinct("dst_rep").cast("int").alias("more"))
    asked = asked.join(more, "item_id", "left").select("item_id", "embedding", (F.col("room") + F.coalesce("more", F.lit(0))).alias("room"))
    return cell_pairs(asked, threshold, met.filter(single & (F.col("src") < F.col("dst"))).select("src", "dst"))


def near_duplicates(items: DataFrame, threshold: float = 0.97, method: str = "cells", blocks: int | None = None) -> DataFrame:
    """(item_id, twin, score): ``twin`` is the smallest item with the same vector (score 1), or a
    near one at the threshold. Equal vectors meet by one grouped minimum over their hash and
    numbers; only their first member takes part in the search, so a group of copies never makes
    its pairs."""
    rows = written(items.filter(F.size("embedding") > 0).select("item_id", "embedding", F.xxhash64("embedding").alias("h")), "vectors")
    firsts = written(rows.groupBy("h", "embedding").agg(F.min("item_id").alias("twin")), "first-vectors")
    same = rows.join(firsts, ["h", "embedding"]).filter("item_id <> twin").select("item_id", "twin", F.lit(1.0).alias("score"))
    reps = firsts.select(F.col("twin").alias("item_id"), "embedding")
    near = similar_pairs(reps, threshold, None, None, method, blocks).select(F.col("src").alias("item_id"), F.col("dst").alias("twin"), "score")
    return same.unionByName(near)
