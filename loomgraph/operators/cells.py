"""Similar pairs by a metric-space partition: Voronoi cells, triangle bounds, bounded tasks.

Angles between unit vectors are a metric. Each vector goes to the cell of its nearest pivot; of
every cell the smallest and largest angle to some pivots are known. A vector can only be within
angle r of a member of a cell if its own angle to each of these pivots is within r of that range,
so a row visits just the cells that pass. Cells that lie near each other form blocks of at most a
stated number of rows, larger cells are split over several; a task holds one block and reads its
visitors as a stream, which is cut into lanes of a stated number of rows. Of two blocks only one
is visited, so each pair of rows meets in exactly one task, where both keep no more than their
best partners. Rows are thus copied about rows / (2 x block) + rows / (2 x lane) times, less what
the bounds save, and a task sends at most its rows' best partners.

The pairs inside the blocks come first. A row then knows the score of the last partner for which
it has room there, and from the other blocks takes none that is worse. As rows and visitors are
ordered by these scores, one number tells for a whole tile of products which may count, and
nearly all of them end with one comparison in single precision.

Pairs to be left out are sent to the one task where their rows meet, so they cost one row each,
and a row with many of them needs no more partners than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

PLACES = 4
BLOCK_ROWS = 65_536  # that a task holds: 32 MB of 64 numbers
LANE_ROWS = 262_144  # that it reads past them
PIVOTS = 256
TABLE = 32  # pivots to which the range of angles of each cell is known
STEP = 512  # visitors multiplied with a block at a time
COLUMNS = 1024  # rows of the block that they meet at a time
FEW = 8  # partners: rows that keep no more may be bounded by a tile alone
HELD = 500_000  # pairs found that a task holds before it keeps the best, about
SENT = 8192  # rows of a batch that goes back to Spark, about
NO_ROOM = np.iinfo(np.int32).max  # stands for no bound


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1.0, 1.0))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dims)


@dataclass
class Cells:
    """``rows``: (item_id, room, v, h, cell, block), written. ``low``, ``high``: a cell's range of
    angles to each pivot of the table; ``blocks``: the cells of each block; ``lanes`` of each block."""

    rows: DataFrame
    n: int
    dims: int
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: list[list[int]]
    lanes: list[int]
    reach: float

    def dealt(self, rows: DataFrame | None = None) -> DataFrame:
        """(task, kind, item_id, other, room, v, least): a block's own rows (kind 1) in each of its lanes, and
        rows of earlier blocks that may be within reach (kind 2), each in one lane. ``rows`` are those
        with the scores that they have in their own block (``least``); without, these are null."""
        first = np.cumsum([0, *self.lanes]).tolist()
        id_type = self.rows.schema["item_id"].dataType.simpleString()
        pivots, low, high, reach, dims = self.pivots, self.low, self.high, self.reach, self.dims
        blocks, lanes = self.blocks, self.lanes
        rows = self.rows.withColumn("least", F.lit(None).cast("double")) if rows is None else rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in range(0, whole.num_rows, SENT):
                    yield from copies(whole.slice(s, SENT))

        def copies(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            angle = _angles(_vectors(b.column("v"), dims), pivots[:TABLE])
            own, h = b.column("block").to_numpy(), b.column("h").to_numpy()
            held, n = [], 0  # a row has as many copies as there are blocks and lanes: they leave by the batch
            for k, cells in enumerate(blocks):
                mine = np.flatnonzero(own == k)
                for lane in range(lanes[k]):
                    held.append((mine, np.full(len(mine), first[k] + lane), np.full(len(mine), 1)))
                before = np.flatnonzero(own < k)
                near = np.zeros(len(before), bool)
                for c in cells:
                    near |= ((angle[before] >= low[c] - reach) & (angle[before] <= high[c] + reach)).all(axis=1)
                met = before[near]
                held.append((met, first[k] + h[met] % lanes[k], np.full(len(met), 2)))
                n += len(mine) * lanes[k] + len(met)
                if n >= SENT or k == len(blocks) - 1:
                    at, task, kind = (np.concatenate(x) for x in zip(*held, strict=True))
                    held, n = [], 0
                    for s in range(0, len(at), SENT):
                        e = s + SENT
                        took = pa.array(at[s:e])
                        yield pa.RecordBatch.from_arrays([pa.array(task[s:e].astype(np.int32)), pa.array(kind[s:e].astype(np.int32)), b.column("item_id").take(took), pa.nulls(len(took), b.schema.field("item_id").type), b.column("room").take(took), b.column("v").take(took), b.column("least").take(took)], ["task", "kind", "item_id", "other", "room", "v", "least"])

        return rows.mapInArrow(run, f"task int, kind int, item_id {id_type}, other {id_type}, room int, v binary, least double")

    def left_out(self, exclude: DataFrame) -> DataFrame:
        """``exclude`` (src, dst) in the form of ``dealt`` (kind 0), each pair in the task where it meets;
        ``inside``: both rows are of one block, which is then the task."""
        side = lambda name: self.rows.select(F.col("item_id").alias(name), F.col("block").alias(f"{name}_b"), F.col("h").alias(f"{name}_h"))
        met = exclude.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
        inside = F.col("src_b") == F.col("dst_b")
        later = F.col("src_b") > F.col("dst_b")
        pick = lambda x, y: F.when(later, F.col(x)).otherwise(F.col(y))
        first = F.array(*[F.lit(int(n)) for n in np.cumsum([0, *self.lanes])])
        lanes = F.array(*[F.lit(n) for n in self.lanes])
        block = pick("src_b", "dst_b")
        task = F.when(inside, block).otherwise(F.element_at(first, block + 1) + pick("dst_h", "src_h") % F.element_at(lanes, block + 1)).cast("int")
        return met.select(task.alias("task"), F.lit(0).alias("kind"), pick("src", "dst").alias("item_id"), pick("dst", "src").alias("other"), F.lit(None).cast("int").alias("room"), F.lit(None).cast("binary").alias("v"), F.lit(None).cast("double").alias("least"), inside.alias("inside"))

    def _inside(self, threshold: float, out: DataFrame | None) -> DataFrame:
        """(kind, src, dst, score, room, v, h, block): the pairs inside the blocks (kind 0), and the rows
        (kind 1: src) with the score of the last partner that each has room for, or the threshold."""
        dims, id_type = self.dims, self.rows.schema["item_id"].dataType.simpleString()
        sent = self.rows.select(F.col("block").alias("task"), F.lit(1).alias("kind"), "item_id", F.lit(None).cast(id_type).alias("other"), "room", "v", "h")
        if out is not None:
            sent = sent.unionByName(out.filter("inside").drop("inside", "least").withColumn("h", F.lit(None).cast("long")))
        parts = max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * len(self.blocks))

        def rows(block: _Block) -> Iterator[pa.RecordBatch]:
            yield from (pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), *b.columns, *(pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.binary(), pa.int64(), pa.int32()))], names) for b in block.finished())
            at = 0
            for p in block.kept:
                n = p.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), p.column("item_id"), pa.nulls(n, p.column("item_id").type), pa.array(block.least[at : at + n]), p.column("room"), p.column("v"), p.column("h"), pa.array(np.full(n, block.task, np.int32))], names)
                at += n

        names = ["kind", "src", "dst", "score", "room", "v", "h", "block"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _met(batches, lambda task: _Block(task, True, threshold, dims, keep=True), rows)

        return sent.repartition(parts, "task").sortWithinPartitions("task", "kind", "item_id").mapInArrow(run, f"kind int, src {id_type}, dst {id_type}, score double, room int, v binary, h long, block int")

    def pairs(self, threshold: float, exclude: DataFrame | None = None) -> DataFrame:
        """(src, dst, score) at the threshold or above, both directions; of each row its best
        ``room`` partners in every task (all without one), ties by the partner."""
        out = None if exclude is None else written(self.left_out(exclude), "left-out")
        inside = written(self._inside(threshold, out), "inside")
        found = inside.filter("kind = 0").select("src", "dst", "score")
        if len(self.blocks) < 2:
            return found
        dims = self.dims
        sent = self.dealt(inside.filter("kind = 1").select(F.col("src").alias("item_id"), "room", "v", "h", "block", F.col("score").alias("least")))
        if out is not None:
            sent = sent.unionByName(out.filter("NOT inside").drop("inside"))
        parts = max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sum(self.lanes))
        id_type = self.rows.schema["item_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _met(batches, lambda task: _Block(task, False, threshold, dims), _Block.finished)

        met = sent.repartition(parts, "task").sortWithinPartitions("task", "kind", "item_id").mapInArrow(run, f"src {id_type}, dst {id_type}, score double")
        return found.unionByName(met)


def _met(batches: Iterator[pa.RecordBatch], begin: Callable[[int], _Block], end: Callable[[_Block], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What the blocks of a partition send; its rows lie by task and kind."""
    held: _Block | None = None
    for b in batches:
        task, kind = b.column("task").to_numpy(), b.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(task) != 0) | (np.diff(kind) != 0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            if held is None or held.task != task[s]:
                if held is not None:
                    yield from end(held)
                held = begin(int(task[s]))
            yield from held.take(int(kind[s]), b.slice(s, e - s))
    if held is not None:
        yield from end(held)


class _Block:
    """A task's own rows, the pairs to leave out, and the best partners of its rows so far. Own rows
    and visitors each arrive in the order of their ids, so the numbers in which they came rank them.

    Products are taken in single precision first; only pairs that may count by them, with room
    for its error and for the rounding, are scored in full. ``least`` of a row is a score that its
    partners must reach: the threshold, or what it knows to be the last it has room for. The columns
    of ``single`` are the own rows by ``least``, so a tile of them has one bound that is near all of its rows'."""

    def __init__(self, task: int, own_pairs: bool, threshold: float, dims: int, keep: bool = False):
        self.task, self.own_pairs, self.threshold, self.dims, self.keep = task, own_pairs, threshold, dims, keep
        self.slack = 0.5 * 10**-PLACES + 2e-7 * dims + 1e-6
        self.parts: list[pa.RecordBatch] = []
        self.kept: list[pa.RecordBatch] = []  # the own rows as they came, if they are asked for
        self.out: dict = {}
        self.ready = False
        self.kind: pa.DataType | None = None
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_found = 0
        self.names: list[np.ndarray] = []  # of the visitors that ``found`` numbers
        self.n_names = 0
        self.buffer = np.empty(STEP * COLUMNS, np.float32)
        self.flags = np.empty(STEP * COLUMNS, bool)

    def take(self, kind: int, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.kind = part.column("item_id").type
        if kind == 0:
            for a, b in zip(part.column("item_id").to_pylist(), part.column("other").to_pylist(), strict=True):
                self.out.setdefault(a, set()).add(b)
                self.out.setdefault(b, set()).add(a)
        elif kind == 1:
            self.parts.append(part)
        else:
            yield from self._prepare()
            ids, rooms, least = np.array(part.column("item_id").to_pylist(), dtype=object), self._rooms(part), self._least(part)
            v = _vectors(part.column("v"), self.dims)
            order, first = np.argsort(least, kind="stable"), self.n_names
            self.names.append(ids)
            self.n_names += len(ids)
            for s in range(0, len(order), STEP):
                mine = order[s : s + STEP]
                yield from self._meet(ids[mine], rooms[mine], least[mine], v[mine], first + mine)
            if self.n_found > HELD // 4:
                self._narrow()
                names = np.concatenate(self.names)
                own, dst, score = self.found[0]
                used, place = np.unique(dst, return_inverse=True)  # in order: so are the new numbers
                self.found, self.names, self.n_names = [(own, place, score)], [names[used]], len(used)

    @staticmethod
    def _rooms(part: pa.RecordBatch) -> np.ndarray:
        return part.column("room").fill_null(NO_ROOM).to_numpy(zero_copy_only=False)

    def _least(self, part: pa.RecordBatch) -> np.ndarray:
        if "least" not in part.schema.names:
            return np.full(part.num_rows, self.threshold)
        return part.column("least").fill_null(self.threshold).to_numpy(zero_copy_only=False)

    def _prepare(self) -> Iterator[pa.RecordBatch]:
        if self.ready:
            return
        self.ready = True
        self.ids = np.array([i for p in self.parts for i in p.column("item_id").to_pylist()], dtype=object)
        self.rooms = np.concatenate([self._rooms(p) for p in self.parts]) if self.parts else np.zeros(0, int)
        self.least = np.concatenate([self._least(p) for p in self.parts]) if self.parts else np.zeros(0)
        self.v = np.concatenate([_vectors(p.column("v"), self.dims) for p in self.parts]) if self.parts else np.zeros((0, self.dims))
        self.kept = self.parts if self.keep else []
        self.parts = []
        self._ordered()
        if self.own_pairs:
            for s in range(0, len(self.ids), STEP):
                yield from self._meet_own(np.arange(s, min(s + STEP, len(self.ids))))
            if not self.keep:
                self._ordered()

    def _ordered(self) -> None:
        """The own rows as columns, by what their partners must reach."""
        self.order = np.argsort(self.least, kind="stable")
        self.place = np.empty(len(self.order), int)
        self.place[self.order] = np.arange(len(self.order))
        self.single = [np.ascontiguousarray(self.v[self.order[c : c + COLUMNS]].T, dtype=np.float32) for c in range(0, len(self.order), COLUMNS)]
        self.at = {x: i for i, x in enumerate(self.ids.tolist())} if self.out else {}

    def _near(self, low: np.ndarray, tile: np.ndarray) -> np.ndarray:
        """The products of rows with the columns of a tile, which are good until the next call."""
        n = len(low), tile.shape[1]
        return np.matmul(low, tile, out=self.buffer[: n[0] * n[1]].reshape(n))

    def _reached(self, near: np.ndarray, bound) -> np.ndarray:
        """Flat places of the products at a bound: eight at a time are passed over."""
        flags = np.greater_equal(near, bound, out=self.flags[: near.size].reshape(near.shape)).ravel()
        if len(flags) % 8:
            return np.flatnonzero(flags)
        some = np.flatnonzero(flags.view(np.uint64) != 0)
        i, j = np.nonzero(flags.reshape(-1, 8)[some])
        return some[i] * 8 + j

    def _gone(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the pairs to leave out, by column."""
        if not self.out:
            return np.zeros(0, int), np.zeros(0, int)
        pairs = [(self.place[self.at[y]], r) for r, x in enumerate(ids.tolist()) for y in self.out.get(x, ()) if y in self.at]
        c, r = np.array(sorted(pairs), int).reshape(-1, 2).T
        return r, c

    def _hidden(self, near: np.ndarray, gone: tuple[np.ndarray, np.ndarray], c: int) -> None:
        if len(gone[1]):
            s, e = np.searchsorted(gone[1], (c, c + near.shape[1]))
            near[gone[0][s:e], gone[1][s:e] - c] = -2.0

    def _scores(self, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # Equal scores of (a, b) and (b, a): the same products are summed in the same order.
        return np.concatenate([np.round(np.einsum("ij,ij->i", v[i[s : s + 65536]], self.v[j[s : s + 65536]]), PLACES) for s in range(0, len(i), 65536)] or [np.zeros(0)])

    def _best_products(self, near: np.ndarray, rooms: np.ndarray, axis: int) -> np.ndarray | np.floating:
        """What a row (axis 1) or column must reach by the products of this tile alone."""
        few = (rooms > 0) & (rooms <= FEW)
        r = int(rooms[few].max()) if few.any() else 0
        n = near.shape[axis]
        if not 0 < r <= n:
            return np.full(len(rooms), -np.inf)
        return np.where(few, np.partition(near, n - r, axis=axis).take(n - r, axis=axis) - self.slack, -np.inf)

    def _meet_own(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Own rows and all own rows: the best partners of the former."""
        ids, rooms, v, bound = self.ids[rows], self.rooms[rows], self.v[rows], self.least[rows]
        r, c = self._gone(ids)
        r, c = np.concatenate((r, np.arange(len(rows)))), np.concatenate((c, self.place[rows]))
        by = np.argsort(c, kind="stable")
        yield from self._meet(ids, rooms, bound, v, None, (r[by], c[by]))
        self.least[rows] = self.reached

    def _meet(self, ids: np.ndarray, rooms: np.ndarray, least: np.ndarray, v: np.ndarray, numbers: np.ndarray | None, gone: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        """Rows and all own rows: pairs that may be among the best of either; of the former alone
        without ``numbers``. ``reached``: what a row's partners must reach after that."""
        low = v.astype(np.float32)
        gone = self._gone(ids) if gone is None else gone
        bound, held, n = least.copy(), [], 0
        bounded, own_bounded = rooms != NO_ROOM, self.rooms != NO_ROOM
        for c, tile in zip(range(0, len(self.order), COLUMNS), self.single, strict=True):
            near = self._near(low, tile)
            self._hidden(near, gone, c)
            cols = self.order[c : c + COLUMNS]
            if numbers is None:
                asked = np.full(len(cols), np.inf)
                flat = self._reached(near, (bound - self.slack).astype(np.float32)[:, None])
            else:
                asked = self.least[cols]
                flat = self._reached(near, np.float32(min(bound.min(), asked.min()) - self.slack))
            if not len(flat):
                continue
            if len(flat) * 16 > near.size:
                bound = np.maximum(bound, self._best_products(near, rooms, 1))
                asked = np.maximum(asked, self._best_products(near, self.rooms[cols], 0))
            i, j = np.divmod(flat, near.shape[1])
            few = near.ravel()[flat] >= np.minimum(bound[i], asked[j]) - self.slack
            i, j = i[few], j[few]
            if not len(i):
                continue
            score, own = self._scores(v, i, cols[j]), cols[j]
            few = (score >= self.threshold) & (score >= asked[j])
            if few.any():  # not worse than what an own row has already
                free = few & ~own_bounded[own]
                if free.any():
                    yield from self._rows(self.ids, own[free], ids, i[free], score[free])
                    few &= ~free
                self.found.append((own[few], numbers[i[few]], score[few]))
                self.n_found += int(few.sum())
                if self.n_found > HELD:
                    self._narrow()
            few = (score >= self.threshold) & (score >= bound[i])
            free = few & ~bounded[i]
            if free.any():
                yield from self._rows(ids, i[free], self.ids, own[free], score[free])
                few &= ~free
            held.append((i[few], own[few], score[few]))
            n += int(few.sum())
            if n > 16 * len(ids):
                held = [self._kept(held, rooms, bound)]
                n = 0
        if held:
            i, j, score = self._kept(held, rooms, bound)
            yield from self._rows(ids, i, self.ids, j, score)
        self.reached = bound

    @staticmethod
    def _kept(held: list, rooms: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best partners of each row; a row that has all it has room for has its last one's score as bound."""
        of, dst, score = (np.concatenate(x) for x in zip(*held, strict=True))
        kept = best_places(of, rooms, dst, score)
        of, dst, score = of[kept], dst[kept], score[kept]
        worst = np.full(len(rooms), np.inf)
        np.minimum.at(worst, of, score)
        full = np.bincount(of, minlength=len(rooms)) >= np.maximum(rooms, 1)
        bound[full] = np.maximum(bound[full], worst[full])
        return of, dst, score

    def _narrow(self) -> None:
        self.found = [self._kept(self.found, self.rooms, self.least)]
        self.n_found = len(self.found[0][0])

    def _rows(self, names: np.ndarray, src: np.ndarray, others: np.ndarray, dst: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(src), SENT):
            e = s + SENT
            yield pa.RecordBatch.from_arrays([pa.array(names[src[s:e]].tolist(), self.kind), pa.array(others[dst[s:e]].tolist(), self.kind), pa.array(score[s:e])], ["src", "dst", "score"])

    def finished(self) -> Iterator[pa.RecordBatch]:
        yield from self._prepare()
        if self.found:
            self._narrow()
            own, dst, score = self.found[0]
            self.found, self.n_found = [], 0
            yield from self._rows(self.ids, own, np.concatenate(self.names), dst, score)


def best_places(of: np.ndarray, rooms: np.ndarray, dst: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of each row's best partners, at most its room: by score, ties by the partner."""
    if not len(of):
        return np.zeros(0, int)
    rank = np.unique(dst, return_inverse=True)[1] if dst.dtype == object else dst
    order = np.lexsort((rank, -score, of))
    sorted_of = of[order]
    first = np.searchsorted(sorted_of, sorted_of)
    return order[np.arange(len(order)) - first < rooms[sorted_of]]


def _chained(pivots: np.ndarray) -> list[int]:
    """The pivots so that each is followed by the nearest one left."""
    left, out = set(range(1, len(pivots))), [0]
    near = pivots @ pivots.T
    while left:
        out.append(max(left, key=lambda c: (near[out[-1], c], -c)))
        left.discard(out[-1])
    return out


def metric_cells(items: DataFrame, threshold: float, block_rows: int | None = None, lane_rows: int | None = None) -> Cells | None:
    """The cells of ``items`` (item_id, embedding, room); None if there is no vector. Vectors of
    another length than the longest, and zero ones at a positive threshold, match nothing and are
    left out. The driver sees pivots x numbers and one range a cell and table pivot, nothing that
    grows with the rows."""
    spark = items.sparkSession
    dims = items.agg(F.max(F.size("embedding"))).first()[0] or 0
    if dims <= 0:
        return None
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    rows = items.filter(F.size("embedding") == dims).withColumn("_n", norm)
    rows = rows.filter("_n > 0") if threshold > 0 else rows
    sampled = rows.filter("_n > 0").select("embedding", F.xxhash64("item_id").alias("k")).orderBy("k").limit(PIVOTS).collect()
    pivots = np.array([r["embedding"] for r in sampled], dtype=float).reshape(-1, dims)
    if not len(pivots):
        pivots = np.eye(1, dims)
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    id_type = items.schema["item_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            n = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
            cell = _angles(v, pivots).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("room"), pa.array([x.tobytes() for x in v], pa.binary()), b.column("h"), pa.array(cell)], ["item_id", "room", "v", "h", "cell"])

    whole = rows.select("item_id", "room", F.col("embedding").cast("array<double>").alias("embedding"), F.shiftrightunsigned(F.xxhash64("item_id"), 1).alias("h"))
    placed = written(whole.mapInArrow(assign, f"item_id {id_type}, room int, v binary, h long, cell int"), "cells")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            angle, cell = _angles(_vectors(b.column("v"), dims), pivots[:TABLE]), b.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                a = angle[cell == c]
                old = seen.get(c)
                seen[c] = [len(a), a.min(axis=0), a.max(axis=0)] if old is None else [old[0] + len(a), np.minimum(old[1], a.min(axis=0)), np.maximum(old[2], a.max(axis=0))]
        flat = [(c, q, n if q == 0 else 0, float(lo[q]), float(hi[q])) for c, (n, lo, hi) in seen.items() for q in range(len(lo))]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat, strict=True)], ["cell", "q", "n", "lo", "hi"])

    known = placed.select("v", "cell").mapInArrow(ranges, "cell long, q long, n long, lo double, hi double").groupBy("cell", "q").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    low, high, sizes = np.full((len(pivots), min(TABLE, len(pivots))), np.inf), np.full((len(pivots), min(TABLE, len(pivots))), -np.inf), np.zeros(len(pivots), int)
    for r in known:
        low[r["cell"], r["q"]], high[r["cell"], r["q"]] = r["lo"], r["hi"]
        sizes[r["cell"]] += r["n"]
    n = int(sizes.sum())
    if not n:
        return None
    most = block_rows or min(BLOCK_ROWS, max(1024, -(-n // 4)))
    blocks: list[list[int]] = []
    first_of, parts_of, rows_of = {}, {}, []
    filled = most + 1
    for c in _chained(pivots):
        if not sizes[c]:
            continue
        parts = -(-int(sizes[c]) // most)
        if parts > 1 or filled + sizes[c] > most:
            filled = 0
            first_of[c] = len(blocks)
            blocks += [[c] for _ in range(parts)]
            rows_of += [int(sizes[c]) // parts] * parts
            filled = int(sizes[c]) if parts == 1 else most + 1
        else:
            first_of[c] = len(blocks) - 1
            blocks[-1].append(c)
            rows_of[-1] += int(sizes[c])
            filled += int(sizes[c])
        parts_of[c] = parts
    lane = lane_rows or min(LANE_ROWS, most if n <= 4 * BLOCK_ROWS else LANE_ROWS)
    before = np.cumsum([0, *rows_of])
    lanes = [max(1, -(-int(before[k]) // lane)) for k in range(len(blocks))]
    table = spark.createDataFrame([(c, first_of[c], parts_of[c]) for c in first_of], "cell int, first int, parts int")
    block = (F.col("first") + F.shiftrightunsigned("h", 24) % F.col("parts")).cast("int")
    rows = placed.join(F.broadcast(table), "cell").select("item_id", "room", "v", "h", "cell", block.alias("block"))
    reach = float(np.arccos(np.clip(threshold - 0.5 * 10**-PLACES - 1e-9, -1.0, 1.0))) + 1e-9
    return Cells(rows, n, dims, pivots, low, high, blocks, lanes, reach)


def cell_pairs(items: DataFrame, threshold: float, exclude: DataFrame | None = None, block_rows: int | None = None, lane_rows: int | None = None) -> DataFrame:
    """(src, dst, score) of ``items`` (item_id, embedding, room: best partners to keep, null: all)."""
    cells = metric_cells(items, threshold, block_rows, lane_rows)
    if cells is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return items.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, score double")
    return cells.pairs(threshold, exclude)
