"""Operator 12 - centroid clustering of integer vectors by bit-plane popcounts.

A vector of 64 integers is stored as its bit planes: plane p packs bit p of all 64 components
into one unsigned 64-bit word, in two's complement, so the top plane counts negatively. The dot
product of two vectors is then the sum over pairs of planes of their weights times
popcount(plane AND plane), which gives exact dot products and squared distances. A cluster's sum
is read off the planes as well: how often each component has bit p, times the weight of p.

Vectors are packed once into a written table; each round is one narrow pass over it in which
every task sends, for each cluster and plane, 64 counts, so a round's shuffle and what the driver
sees are bounded by tasks x clusters x planes and never depend on a cluster's size. Counts and
sums are exact, so results hang neither on the number of tasks nor on their order.

Defined results: vectors that are null, of another length, or with a null or non-finite component
are left out; repeated rows count as often as they occur; start vectors with one hash (a repeated
or null id) are taken in the order of their planes; with fewer vectors than clusters every vector
is a centroid; an empty table gives an empty result. Components of any size are exact (beyond 27
bits by Python integers); a distance or sum that does not fit a long is null. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

COMPONENTS = 64
ROWS = 2048  # of a block whose counts against all centroids stay in a core's cache
LONG = 2**63


def scaled(values: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) of finite doubles, exactly; Python integers where they pass 27 bits."""
    if not len(values) or np.abs(values).max() < 2**27 / factor:
        return np.floor(values * factor).astype(np.int64)
    exact = lambda x: (lambda n, d: n * factor // d)(*float(x).as_integer_ratio())
    return np.array([[exact(x) for x in row] for row in values], dtype=object)


def planes_of(values: np.ndarray) -> np.ndarray:
    """(n, planes) words from (n, 64) integers."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    width = max(high, -low - 1, 0).bit_length() + 1
    out = np.empty((len(values), width), dtype="<u8")
    for p in range(width):
        bits = ((values >> p) & 1).astype(np.uint8)
        out[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def weights(width: int) -> list[int]:
    return [2**p for p in range(width - 1)] + [-(2 ** (width - 1))]


def values_of(planes: np.ndarray) -> np.ndarray:
    """(n, 64) integers from (n, planes) words."""
    bits = [np.unpackbits(np.ascontiguousarray(planes[:, p : p + 1]).view(np.uint8), axis=1, bitorder="little") for p in range(planes.shape[1])]
    kind = np.int64 if planes.shape[1] < 62 else object
    return sum(b.astype(kind) * w for b, w in zip(bits, weights(planes.shape[1]), strict=True))


def widened(rows: list[bytes]) -> np.ndarray:
    """Stored planes of several vectors as one array; narrow ones repeat their top plane."""
    width = max((len(r) for r in rows), default=8)
    rows = [r if len(r) == width else r + r[-8:] * ((width - len(r)) // 8) for r in rows]
    return np.frombuffer(b"".join(rows), dtype="<u8").reshape(len(rows), width // 8)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products (len(a), len(b)) from planes."""
    wa, wb = weights(a.shape[1]), weights(b.shape[1])
    small = len(wa) + len(wb) + 6 < 62
    out = np.zeros((len(a), len(b)), dtype=np.int64 if small else object)
    for j, u in enumerate(wb):
        part = np.zeros_like(out)
        for i, w in enumerate(wa):
            counts = np.bitwise_count(a[:, i, None] & b[None, :, j])
            part += counts.astype(out.dtype) * w
        out += part * u
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances (len(a), len(b)) from planes."""
    return _norms(a)[:, None] + _norms(b)[None, :] - 2 * dots(a, b)


def _norms(v: np.ndarray) -> np.ndarray:
    w = weights(v.shape[1])
    out = np.zeros(len(v), dtype=np.int64 if 2 * len(w) + 6 < 62 else object)
    for i in range(len(w)):
        for j in range(i, len(w)):
            counts = np.bitwise_count(v[:, i] & v[:, j]).astype(out.dtype)
            out = out + counts * (w[i] * w[j] * (1 if i == j else 2))
    return out


def nearest(a: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of each vector; ties go to the smaller number."""
    at, far = [], []
    for s in range(0, len(a), ROWS):
        d = distances(a[s : s + ROWS], centroids)
        best = d.argmin(axis=1)
        at.append(best)
        far.append(d[np.arange(len(d)), best])
    return np.concatenate(at), np.concatenate(far)


def packed(vectors: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(vec_id, planes): the kept vectors in bit planes, 8 bytes a plane."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            kept = np.flatnonzero(lengths == COMPONENTS)
            values = lists.take(pa.array(kept)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, COMPONENTS)
            finite = np.isfinite(values).all(axis=1)
            kept, values = kept[finite], values[finite]
            words = planes_of(scaled(values, factor))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept)), pa.array([w.tobytes() for w in words], pa.binary())], ["vec_id", "planes"])

    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, f"vec_id {kind}, planes binary")


def plane_counts(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, plane, sign, n, c0 ... c63): how often each component of a cluster's vectors has
    each bit, summed over all tasks; ``n`` counts vectors on the rows of plane 0. The top plane of a
    vector has sign -1."""
    names = [f"c{k}" for k in range(COMPONENTS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            words = widened(b["planes"].tolist())
            at, _ = nearest(words, centroids)
            order = np.argsort(at, kind="stable")
            found, first = np.unique(at[order], return_index=True)
            sizes = np.diff(np.append(first, len(at)))
            for p in range(words.shape[1]):
                bits = np.unpackbits(np.ascontiguousarray(words[order, p : p + 1]).view(np.uint8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
                sign = -1 if p == words.shape[1] - 1 else 1
                for c, n, row in zip(found.tolist(), sizes.tolist(), ones, strict=True):
                    row = np.append(n if p == 0 else 0, row)
                    key = c, p, sign
                    held[key] = held[key] + row if key in held else row
        if held:
            yield pd.DataFrame(np.array([[*k, *v] for k, v in held.items()], dtype=np.int64), columns=["cluster", "plane", "sign", "n", *names])

    schema = "cluster long, plane long, sign long, n long, " + ", ".join(f"{c} long" for c in names)
    return rows.select("planes").mapInPandas(run, schema).groupBy("cluster", "plane", "sign").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


@dataclass
class Clusters:
    """``rows``: (vec_id, cluster, distance) for each kept vector; ``centroids``: (k, 64) integers;
    ``inertia``: distance summed over each cluster (None: does not fit a long, 0: empty)."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int | None]


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, factor: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Lloyd's rounds over floor(factor * x), from the ``k`` vectors whose hash of ``seed:id`` is
    smallest. ``k`` x 64 numbers and their planes are all that the driver and a task's closure hold."""
    spark = vectors.sparkSession
    rows = written(packed(vectors, id_col, vector_col, factor), "planes")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = rows.select(mark.alias("h"), "planes").orderBy("h", "planes").limit(k).collect()
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not start:
        return Clusters(spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), [], [])
    centroids = [[int(x) for x in row] for row in values_of(widened([bytes(r["planes"]) for r in start]))]
    for _ in range(rounds):
        sums, sizes = {}, {}
        for r in plane_counts(rows, _planes(centroids)).collect():
            own = sums.setdefault(r["cluster"], [0] * COMPONENTS)
            sizes[r["cluster"]] = sizes.get(r["cluster"], 0) + r["n"]
            for i in range(COMPONENTS):
                own[i] += r["sign"] * 2 ** r["plane"] * r[f"c{i}"]
        centroids = [[s // sizes[c] for s in sums[c]] if c in sums else old for c, old in enumerate(centroids)]
    final = _planes(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, far = nearest(widened(b.column("planes").to_pylist()), final)
                far = pa.array([int(x) if x < LONG else None for x in far], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at.astype(np.int32)), far], ["vec_id", "cluster", "distance"])

    assigned = written(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    found = {r[0]: int(r[1]) if r[1] is not None and r[2] == 0 else None for r in assigned.groupBy("cluster").agg(total, F.count(F.when(F.col("distance").isNull(), 1))).collect()}
    inertia = [_long(found.get(c, 0)) for c in range(len(centroids))]
    return Clusters(assigned, centroids, inertia)


def _planes(centroids: list[list[int]]) -> np.ndarray:
    most = max(abs(x) for c in centroids for x in c)
    return planes_of(np.array(centroids, dtype=np.int64 if most < 2**27 else object))


def _long(n: int | None) -> int | None:
    return n if n is not None and n < LONG else None


def cluster_report(found: Clusters) -> DataFrame:
    """``rows`` with their cluster's and the whole inertia and the centroid's sha256."""
    spark = found.rows.sparkSession
    whole = _long(sum(found.inertia)) if None not in found.inertia else None
    of = [(c, i, whole, hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for c, (m, i) in enumerate(zip(found.centroids, found.inertia, strict=True))]
    table = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
