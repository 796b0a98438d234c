"""Corpus-wide greedy grouping that compares with leaders and keeps no edge table.

A corpus is one scope, too large for a task. By the set definition of the
grouping (see ``grouping``) only leaders matter for what comes later, so the
items, in position order, are grouped like this:

* up to ``leaf_rows`` items are grouped in one task;
* more items are compared block by block. Where near pairs are few, they are the
  edges of parallel rounds. The job that looks for them writes no more than ``EDGES`` rows an
  item: a block pair with more gives one row that says so and no edges;
* then the first items (``leaf_rows``, twice as many each time that is not enough, at most half) are grouped on their own,
  the others meet those *leaders* only, which gives (leader, member) rows, and what no leader claims is grouped like
  the whole: the clusters that make many pairs are gone by then. A cluster of m near copies costs one leader and m
  rows, never m**2.

Items appended later never change an earlier leader. ``group_onto`` uses this: new items meet
the stored leaders, the rest is grouped as above.

Blocks are sized by memory (``hold_rows``) and by the number of task slots, kept once as files in the checkpoint folder
while they are compared and read there by the tasks that compare them, so no item is copied to a shuffle. Of sparse rows
only those are multiplied whose norms over groups of buckets leave the threshold within reach (``_Hits``).
"""

from __future__ import annotations

import math
import uuid
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from echoset.operators.grouping import assign_members, greedy_leaders
from echoset.operators.pairs import LENGTH_ERROR
from echoset.session import drop_folder, ensure_checkpoint_dir, let_go

TILE = 1024  # rows multiplied at once
EDGES = 64  # edges an item that are written before a corpus is split
LEAF_ROWS = {True: 16384, False: 4096}  # by sparse or dense
HOLD_ROWS = {True: 16384, False: 16384}
BOUNDS, BOUND_MARGIN = 256, 1e-4  # groups of buckets whose norms bound a similarity from above; room for single precision
STAGES = ((32, 32), (128, 128), (512, 256))  # bounds, each closer: heaviest buckets alone, groups of the others
PAIRWISE = 24  # cells of a product that cost as much as one pair taken by itself
WIDTH = 1 << 12  # buckets up to which rows are laid out over all of them
LAID_CELLS = 1 << 24  # cells of a block that may be laid out at once
AT_ONCE = 4  # right blocks of a task
BROADCAST_ROWS = 1 << 19  # positions sent to every executor to leave them out
PROBED = 8  # blocks from which a few pairs are looked at first


class _Rows:
    """Rows of a block, cut in tiles, ready to be multiplied.

    By position, or (``alike``) rows with like numbers of buckets in one stretch of that many, in it those whose
    heaviest buckets are the same side by side.
    """

    def __init__(self, cols: dict, sparse: bool, alike: int = 0, ordered: bool = False):
        """``cols``: ``v`` and either ``idx``, ``cnt`` (as values and lengths), ``sq`` or ``vector``; ``ordered``: as they lie."""
        order = np.arange(len(cols["v"])) if ordered else np.argsort(cols["v"], kind="stable")
        self.sparse, self.used, self.laid, self.staged = sparse, {}, {}, {}
        if sparse:
            self.idx, size = cols["idx"]
            self.cnt = cols["cnt"][0]
            self.sq = cols["sq"].astype(np.float64, copy=False)
            self.ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            if alike:
                order = self._alike(order, alike)
            if not ordered:
                self._take(order)
        else:
            vectors = [cols["vector"][i] for i in order]
            if len({len(x) for x in vectors}) > 1:
                raise ValueError(LENGTH_ERROR)
            self.vec = np.array(vectors, np.float64).reshape(len(order), -1)
            self.sq = (self.vec * self.vec).sum(axis=1)
        self.order, self.pos = order, cols["v"][order]

    def _alike(self, order: np.ndarray, stretch: int) -> np.ndarray:
        order = order[np.argsort(np.diff(self.ends)[order], kind="stable")]
        heavy = self.bound(0, len(self.sq), self.places(*STAGES[0]))[order, :STAGES[0][0]]
        by = np.argsort(-heavy, axis=1, kind="stable")[:, :2]
        return order[np.lexsort((by[:, 1], by[:, 0], np.arange(len(order)) // stretch))]

    def _take(self, rows: np.ndarray) -> None:
        at, row = self._entries(rows)
        self.idx, self.cnt, self.sq = self.idx[at], self.cnt[at], self.sq[rows]
        self.ends = np.searchsorted(row, np.arange(len(rows) + 1))

    def part(self, rows: np.ndarray, alike: int = 0):
        """Some rows as a block of their own, whose bounds have the same places; ``order``: where in ``rows`` each was."""
        out = object.__new__(_Rows)
        out.sparse, out.used, out.laid, out.staged = self.sparse, {}, {}, {}
        if self.sparse:
            out.idx, out.cnt, out.sq, out.ends, out.heavy = self.idx, self.cnt, self.sq, self.ends, self.heavy
            out._take(rows)
            order = out._alike(np.arange(len(rows)), alike) if alike else np.arange(len(rows))
            if alike:
                out._take(order)
        else:
            order = np.arange(len(rows))
            out.vec, out.sq = self.vec[rows], self.sq[rows]
        out.order, out.pos = order, self.pos[rows][order]
        return out

    @classmethod
    def of_arrow(cls, batch, sparse: bool, alike: int = 0, ordered: bool = False):
        """From an Arrow record batch; lists are read in place."""
        cols = dict(zip(batch.schema.names, batch.columns))
        out = {"v": cols["v"].to_numpy(zero_copy_only=False)}
        for c in ("idx", "cnt"):
            if sparse:
                out[c] = cols[c].flatten().to_numpy(zero_copy_only=False), cols[c].value_lengths().to_numpy(zero_copy_only=False)
        if sparse:
            out["sq"] = cols["sq"].to_numpy(zero_copy_only=False)
        else:
            out["vector"] = [np.asarray(x, np.float64) for x in cols["vector"].to_numpy(zero_copy_only=False)]
        return cls(out, sparse, alike, ordered)

    def __len__(self):
        return len(self.pos)

    @property
    def bounds(self) -> np.ndarray:
        """Norms over ``BOUNDS`` groups of buckets."""
        return self.bound(0, len(self.sq), lambda idx: (idx % BOUNDS, BOUNDS))

    @cached_property
    def heavy(self) -> np.ndarray:
        """Buckets by their weight in the unit vectors, the heaviest first."""
        most = max(k for k, _ in STAGES)
        ids, at = np.unique(self.idx, return_inverse=True) if self.idx.max(initial=0) >= 1 << 20 else (None, self.idx)
        weight = np.bincount(at, self._squares(0, len(self.sq)))
        by = np.argsort(-weight, kind="stable")[:most]
        return by if ids is None else ids[by]

    def places(self, alone: int, groups: int):
        """A map of buckets to the places of a bound: this block's heaviest have one each, the others share ``groups``."""
        heavy = self.heavy[:alone]
        by = np.argsort(heavy)
        ids = heavy[by]

        def sought(idx):
            at = np.minimum(np.searchsorted(ids, idx), max(0, len(ids) - 1))
            return np.where(ids[at] == idx, by[at], alone + idx % groups) if len(ids) else alone + idx % groups

        table = sought(np.arange(WIDTH))
        return lambda idx: (table[idx] if idx.max(initial=0) < WIDTH else sought(idx), alone + groups)

    def _squares(self, lo: int, hi: int) -> np.ndarray:
        """Each bucket's share of its row's squared norm."""
        a, b = self.ends[lo], self.ends[hi]
        cnt = self.cnt[a:b].astype(np.float64)
        return cnt * cnt / np.repeat(np.where(self.sq > 0, self.sq, 1)[lo:hi], np.diff(self.ends[lo:hi + 1]))

    def bound(self, lo: int, hi: int, places) -> np.ndarray:
        """Norms of unit vectors over groups of buckets: their dot product is no less than the similarity."""
        at, width = places(self.idx[self.ends[lo]:self.ends[hi]])
        row = np.repeat(np.arange(hi - lo), np.diff(self.ends[lo:hi + 1]))
        return np.sqrt(np.bincount(row * width + at, self._squares(lo, hi), (hi - lo) * width).reshape(-1, width)).astype(np.float32)

    def buckets(self, lo: int, hi: int) -> np.ndarray:
        if (lo, hi) not in self.used:
            self.used[lo, hi] = np.unique(self.idx[self.ends[lo]:self.ends[hi]])
        return self.used[lo, hi]

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows' buckets lie, and the place in ``rows`` each belongs to."""
        size = self.ends[rows + 1] - self.ends[rows]
        row = np.repeat(np.arange(len(rows)), size)
        return np.arange(len(row)) + np.repeat(self.ends[rows] - (np.cumsum(size) - size), size), row

    def dense(self, rows: np.ndarray, cols: np.ndarray | int, kind) -> np.ndarray:
        """Rows laid out over some buckets, or over the first so many."""
        at, row = self._entries(rows)
        idx, cnt = self.idx[at], self.cnt[at]
        if isinstance(cols, int):
            out = np.zeros((len(rows), cols), kind)
            out[row, idx] = cnt
            return out
        out = np.zeros((len(rows), len(cols)), kind)
        at = np.minimum(np.searchsorted(cols, idx), max(0, len(cols) - 1))
        if len(cols):
            ok = cols[at] == idx
            out[row[ok], at[ok]] = cnt[ok]
        return out

    def some(self, lo: int, hi: int, rows: np.ndarray, cols: np.ndarray | int, kind) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a tile (``rows`` counted from ``lo``) laid out, and where in that each row of the tile lies.

        A tile of which most rows are asked for is laid out whole and kept while those kept take few cells.
        """
        if 2 * len(rows) < hi - lo:
            place = np.zeros(hi - lo, np.int64)
            place[rows] = np.arange(len(rows))
            return self.dense(lo + rows, cols, kind), place
        if any(c is not cols for c, _ in self.laid.values()):
            self.laid.clear()
        if (lo, hi, kind) not in self.laid:
            out = self.dense(np.arange(lo, hi), cols, kind)
            if sum(t.size for _, t in self.laid.values()) + out.size > LAID_CELLS:
                return out, np.arange(hi - lo)
            self.laid[lo, hi, kind] = cols, out
        return self.laid[lo, hi, kind][1], np.arange(hi - lo)


def _similar(x: _Rows, a: int, b: int, y: _Rows, c: int, d: int) -> np.ndarray:
    """Similarities of rows a to b with rows c to d; zero vectors are like nothing."""
    if x.sparse:  # counts: exact in single precision while sums stay below 2**24
        cols = np.intersect1d(x.buckets(a, b), y.buckets(c, d), assume_unique=True)
        kind = np.float32 if max(x.sq.max(initial=0), y.sq.max(initial=0)) < 1 << 24 else np.float64
        dot = (x.dense(np.arange(a, b), cols, kind) @ y.dense(np.arange(c, d), cols, kind).T).astype(np.float64)
        norm = np.sqrt(np.outer(x.sq[a:b], y.sq[c:d]))
    else:
        if x.vec.shape[1] != y.vec.shape[1]:
            raise ValueError(LENGTH_ERROR)
        dot = x.vec[a:b] @ y.vec[c:d].T
        norm = np.outer(np.sqrt(x.sq[a:b]), np.sqrt(y.sq[c:d]))
    with np.errstate(invalid="ignore", divide="ignore"):
        out = dot / norm
    out[norm == 0] = 0.0
    return out


def _tiles(n: int) -> list[tuple[int, int]]:
    return [(lo, min(n, lo + TILE)) for lo in range(0, n, TILE)]


class _Hits:
    """The pairs of two blocks at the threshold, tile by tile.

    Of sparse rows, those are multiplied that the bounds (see ``STAGES``), looked at one after the other, leave open:
    all such rows and columns of a part of the tile, or pair by pair if they are few. The margin covers the bounds'
    single precision.
    """

    def __init__(self, x: _Rows, y: _Rows, threshold: float):
        self.x, self.y, self.threshold, self.staged = x, y, threshold, {}
        self.low = np.float32(threshold - BOUND_MARGIN)
        if x.sparse:
            width = int(max(x.idx.max(initial=0), y.idx.max(initial=0))) + 1
            self.cols = WIDTH if width <= WIDTH else np.intersect1d(x.buckets(0, len(x)), y.buckets(0, len(y)), assume_unique=True)
            self.kind = np.float32 if max(x.sq.max(initial=0), y.sq.max(initial=0)) < 1 << 24 else np.float64

    def _bound(self, k: int, left: bool, lo: int, hi: int) -> np.ndarray:
        """Stage ``k`` of a tile, over the left block's places; a block keeps those over its own for other blocks."""
        rows = self.x if left else self.y
        kept = rows.staged if rows.heavy is self.x.heavy else self.staged
        if (k, lo, hi) not in kept:
            kept[k, lo, hi] = rows.bound(lo, hi, self.x.places(*STAGES[k]))
        return kept[k, lo, hi]

    def of(self, a: int, b: int, c: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns (from ``a`` and ``c``) and similarities."""
        x, y = self.x, self.y
        if not x.sparse or not self.threshold > 0:
            sim = _similar(x, a, b, y, c, d)
            with np.errstate(invalid="ignore"):
                i, j = np.nonzero(sim >= self.threshold)  # NaN compares False
            return i, j, sim[i, j]
        open_ = self._bound(0, True, a, b) @ self._bound(0, False, c, d).T >= self.low
        part = max(1, TILE // 4)
        parts = []
        for p in range(0, b - a, part):
            for q in range(0, d - c, part):
                i, j, some = _left_open(p + np.arange(min(part, b - a - p)), q + np.arange(min(part, d - c - q)),
                                        open_[p:p + part, q:q + part])
                for k in range(1, len(STAGES)):
                    if len(i):
                        i, j, some = _left_open(i, j, _closer(self._bound(k, True, a, b), self._bound(k, False, c, d), i, j, some, self.low))
                if len(i):
                    parts.append((i, j, some))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if parts:
            left, at = x.some(a, b, np.unique(np.concatenate([i for i, _, _ in parts])), self.cols, self.kind)
            right, to = y.some(c, d, np.unique(np.concatenate([j for _, j, _ in parts])), self.cols, self.kind)
        for i, j, some in parts:
            r, s, dot = _products(left, right, at[i], to[j], some)
            i, j = i[r], j[s]
            with np.errstate(invalid="ignore", divide="ignore"):
                norm = np.sqrt(x.sq[a + i] * y.sq[c + j])
                sim = np.where(norm > 0, dot.astype(np.float64) / norm, 0.0)
                hit = sim >= self.threshold
            found.append((i[hit], j[hit], sim[hit]))
        return tuple(np.concatenate(f) for f in zip(*found))


def _left_open(i: np.ndarray, j: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``i`` and columns ``j`` without those that have no open cell in ``some``."""
    if some.shape[1] % 8:
        r, s = np.flatnonzero(some.any(axis=1)), np.flatnonzero(some.any(axis=0))
    else:  # eight cells at once
        eights = some.view(np.uint64)
        r, s = np.flatnonzero(np.bitwise_or.reduce(eights, axis=1)), np.flatnonzero(np.bitwise_or.reduce(eights, axis=0).view(bool))
    if 4 * len(r) > 3 * len(i) and 4 * len(s) > 3 * len(j):  # few to leave out: not worth a copy of the others
        return i, j, some
    return i[r], j[s], some[r][:, s]


def _at(x: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Rows ``i`` (ascending) of ``x``, not copied if they lie side by side."""
    return x[i[0]:i[-1] + 1] if i[-1] - i[0] + 1 == len(i) else x[i]


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, some: np.ndarray):
    """The open cells of ``some`` (rows ``i`` of ``x`` by rows ``j`` of ``y``) and their dot products."""
    r, s = np.nonzero(some)
    if len(r) * PAIRWISE > some.size:
        return r, s, (_at(x, i) @ _at(y, j).T)[r, s]
    out = np.empty(len(r), x.dtype)
    step = max(1, (1 << 18) // x.shape[1])
    for k in range(0, len(r), step):
        out[k:k + step] = np.einsum("ij,ij->i", x[i[r[k:k + step]]], y[j[s[k:k + step]]])
    return r, s, out


def _closer(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, some: np.ndarray, low) -> np.ndarray:
    """The cells of ``some`` that a closer bound leaves open."""
    if np.count_nonzero(some) * PAIRWISE > some.size:
        return some & (_at(x, i) @ _at(y, j).T >= low)
    r, s, bound = _products(x, y, i, j, some)
    out = np.zeros(some.shape, bool)
    out[r, s] = bound >= low
    return out


def _near(x: _Rows, y: _Rows, threshold: float, limit: int):
    """Edges (a < b by position) between two blocks, or of one with itself; None if more than ``limit``."""
    found, total = [], 0
    hits = _Hits(x, y, threshold)
    for a, b in reversed(_tiles(len(x))):  # rows of many buckets are most alike: too many edges are soon seen
        for c, d in reversed(_tiles(len(y))):
            if x is y and c < a:
                continue
            i, j, sim = hits.of(a, b, c, d)
            if x is y and a == c:
                i, j, sim = i[i < j], j[i < j], sim[i < j]
            total += len(i)
            if total > limit:
                return None
            p, q = x.pos[a + i], y.pos[c + j]
            found.append((np.minimum(p, q), np.maximum(p, q), sim))
    return found


def _claimed(new: _Rows, leaders: _Rows, threshold: float):
    """For each new row its least leader, if any: (rows, leaders' positions, similarities)."""
    least = np.full(len(new), -1)
    sims = np.zeros(len(new))
    hits = _Hits(new, leaders, threshold)
    for a, b in _tiles(len(new)):
        for c, d in _tiles(len(leaders)):
            i, j, sim = hits.of(a, b, c, d)
            order = np.lexsort((leaders.pos[c + j], i))
            i, j, sim = i[order], j[order], sim[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            rows, at = a + i[first], c + j[first]
            less = (least[rows] < 0) | (leaders.pos[at] < leaders.pos[least[rows]])
            least[rows[less]], sims[rows[less]] = at[less], sim[first[less]]
    rows = np.flatnonzero(least >= 0)
    return rows, leaders.pos[least[rows]], sims[rows]


def _led_alone(x: _Rows, threshold: float):
    """(leader, member, similarity) of a whole scope in order of position: stretches meet the leaders so far, then themselves."""
    led: list[_Rows] = []  # the leaders of each stretch
    out = [(x.pos[:0], x.pos[:0], np.empty(0))]
    for a, b in _tiles(len(x)):
        rows, free = x.part(np.arange(a, b)), np.ones(b - a, bool)
        alike = x.part(np.arange(a, b), TILE)
        for leaders in led:  # an earlier stretch's leaders come first
            got, by, sim = _claimed(alike, leaders, threshold)
            got, by, sim = (c[free[alike.order[got]]] for c in (got, by, sim))
            out.append((by, alike.pos[got], sim))
            free[alike.order[got]] = False
        own = rows.part(np.flatnonzero(free))
        near, sim = np.zeros((len(own), len(own)), bool), np.zeros((len(own), len(own)))
        i, j, s = _Hits(own, own, threshold).of(0, len(own), 0, len(own))
        near[i, j], sim[i, j] = True, s
        own_free, first = np.ones(len(own), bool), []
        for k in range(len(own)):  # by position
            if own_free[k]:
                first.append(k)
                member = k + 1 + np.flatnonzero(near[k, k + 1:] & own_free[k + 1:])
                own_free[member] = False
                out.append((np.full(len(member), own.pos[k]), own.pos[member], sim[k, member]))
        led.append(own.part(np.array(first, np.int64), TILE))
    return [np.concatenate(c) for c in zip(*out)]


def _payload(df: DataFrame, pos: str, sparse: bool) -> DataFrame:
    return df.select(F.col(pos).alias("v"), *(("idx", F.col("cnt").cast("array<int>").alias("cnt"), "sq") if sparse else ("vector",)))


def _schema(df: DataFrame) -> T.StructType:
    kind = df.schema["v"].dataType
    return T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("sim", T.DoubleType())])


class _Blocks:
    """Items dealt over ``n_blocks`` blocks by a hash of the position, each an Arrow file of a folder that every task can reach.

    ``first``: only so many of the blocks.
    """

    def __init__(self, items: DataFrame, n_blocks: int, sparse: bool, first: int | None = None):
        spark = items.sparkSession
        self.folder = folder = f"{ensure_checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
        self.spark = spark

        def keep(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            from echoset.sources.documents import open_folder

            own = TaskContext.get().taskAttemptId()
            fs, root = open_folder(folder)
            fs.create_dir(root, recursive=True)
            batches = [x for x in batches if x.num_rows]
            rows = pa.Table.from_batches(batches).combine_chunks() if batches else None
            for blk in sorted(set(rows.column("blk").to_pylist())) if batches else []:
                some = rows.filter(pa.compute.equal(rows.column("blk"), blk)).drop_columns("blk").combine_chunks().to_batches()[0]
                some = some.take(pa.array(_Rows.of_arrow(some, sparse, TILE).order))
                with fs.open_output_stream(f"{root}/_{own}_{blk}") as f:
                    with pa.ipc.new_file(f, some.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                        out.write_batch(some)
                fs.move(f"{root}/_{own}_{blk}", f"{root}/{blk}")  # a repeated attempt replaces a whole file by an equal one
                yield pa.RecordBatch.from_pydict({"blk": pa.array([blk], pa.int32())})

        dealt = items.where(F.col("v").isNotNull()).withColumn("blk", F.pmod(F.xxhash64("v"), F.lit(n_blocks)).cast("int"))
        n_kept = min(n_blocks, first or n_blocks)
        made = dealt.where(F.col("blk") < n_kept).repartitionById(n_kept, "blk").mapInArrow(keep, "blk int")
        self.ids = sorted(r.blk for r in made.collect())  # a number a block

    def __enter__(self):
        return self

    def __exit__(self, *_):
        drop_folder(self.spark, self.folder)


def _met(left: _Blocks, right: _Blocks, pairs: list[tuple[int, list[int]]], run, sparse: bool, schema: T.StructType) -> DataFrame:
    """``run(rows of p, rows of q)`` for blocks p of ``left`` and the given q of ``right``, a task each p and its q."""
    import pyarrow as pa

    arrow, folders = to_arrow_schema(schema), (left.folder, right.folder)

    def each(batches):
        from echoset.sources.documents import open_folder

        def block(folder, blk):
            fs, root = open_folder(folder)
            with fs.open_input_file(f"{root}/{blk}") as f:
                return _Rows.of_arrow(pa.ipc.open_file(f).get_batch(0), sparse, ordered=True)

        for task in (k for batch in batches for k in batch.column(0).to_pylist()):
            p, others = pairs[task]
            x = block(folders[0], p)
            for q in others:
                out = run(x, x if folders[0] == folders[1] and p == q else block(folders[1], q))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    spark = left.spark
    return spark.range(0, len(pairs), 1, max(1, len(pairs))).mapInArrow(each, schema)


def _dealt(p: int, others: list[int]) -> list[tuple[int, list[int]]]:
    """A block and a few others a task: it is read once for them."""
    return [(p, others[k:k + AT_ONCE]) for k in range(0, len(others), AT_ONCE)]


def near_edges(items: DataFrame, n: int, threshold: float, sparse: bool, hold_rows: int, stats: dict) -> DataFrame:
    """Edges ``a, b, sim`` of all pairs of blocks, checkpointed; a row without ends for each block pair that has too many.

    Of many blocks a few pairs are looked at first: rows without ends there are returned at once.
    """
    slots = items.sparkSession.sparkContext.defaultParallelism
    g = max(math.ceil(n / hold_rows), min(math.ceil(math.sqrt(6 * slots)), math.ceil(n / TILE)))
    limit = max(64, EDGES * math.ceil(n / g) // g)
    stats["copied_rows"] = stats.get("copied_rows", 0) + n * g

    def run(x, y):
        found = _near(x, y, threshold, limit)
        if found is None:
            return [None], [None], [0.0]
        return [np.concatenate(c) for c in zip(*found)] if found else ([], [], [])

    def edges(blocks, pairs):
        return _met(blocks, blocks, pairs, run, sparse, _schema(items)).checkpoint(eager=True)

    if g >= PROBED:
        with _Blocks(items, g, sparse, 1 + slots) as few:
            first = edges(few, [(few.ids[0], [q]) for q in few.ids[1:]])
        if first.where("a IS NULL").take(1):
            return first
    with _Blocks(items, g, sparse) as blocks:
        return edges(blocks, [task for k, p in enumerate(blocks.ids) for task in _dealt(p, blocks.ids[k:])])


def claimed_by(new: DataFrame, n_new: int, leaders: DataFrame, n_leaders: int, threshold: float, sparse: bool, hold_rows: int,
               stats: dict) -> DataFrame:
    """``a, b, sim``, checkpointed: each new item's least leader (``a``) at the threshold, of those that have one."""
    slots = new.sparkSession.sparkContext.defaultParallelism
    gl = max(1, math.ceil(n_leaders / hold_rows))
    gn = max(math.ceil(n_new / hold_rows), min(math.ceil(3 * slots / gl), math.ceil(n_new / 256)), 1)
    stats["copied_rows"] = stats.get("copied_rows", 0) + n_new * gl + n_leaders * gn

    def run(x, y):
        rows, least, sims = _claimed(x, y, threshold)
        return least, x.pos[rows], sims

    with _Blocks(new, gn, sparse) as some, _Blocks(leaders, gl, sparse) as others:
        met = _met(some, others, [task for p in some.ids for task in _dealt(p, others.ids)], run, sparse, _schema(new))
        return met.groupBy("b").agg(F.min(F.struct("a", "sim")).alias("m")).select("m.a", "b", "m.sim").checkpoint(eager=True)


def _leaf(items: DataFrame, threshold: float, sparse: bool) -> DataFrame:
    import pyarrow as pa

    schema = _schema(items)
    arrow = to_arrow_schema(schema)

    def run(rows: pa.Table) -> pa.Table:
        led = _led_alone(_Rows.of_arrow(rows.combine_chunks().to_batches()[0], sparse), threshold)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(led, arrow)], schema=arrow)

    return items.where(F.col("v").isNotNull()).groupBy(F.lit(0).alias("key")).applyInArrow(run, schema)  # leaf_rows items at most


def _without(items: DataFrame, members: DataFrame) -> DataFrame:
    gone = members.select(F.col("b").alias("v"))
    if gone.count() <= BROADCAST_ROWS:  # items are kept, so they are read again and not copied
        return items.join(F.broadcast(gone), "v", "left_anti")
    return items.join(gone, "v", "left_anti").checkpoint(eager=True)


def _lead(items: DataFrame, n: int, threshold: float, sparse: bool, leaf_rows: int, hold_rows: int, stats: dict,
          early_rows: int | None = None) -> list[DataFrame]:
    """(leader, member, similarity) rows of ``items``, as checkpointed parts."""
    if n < 2:
        return []
    if n <= leaf_rows:
        return [_leaf(items, threshold, sparse).checkpoint(eager=True)]
    edges = near_edges(items, n, threshold, sparse, hold_rows, stats)
    if not edges.where("a IS NULL").take(1):
        stats["edges"] = stats.get("edges", 0) + edges.count()
        return [assign_members(edges, greedy_leaders(edges, [], stats=stats, edges_checkpointed=True), []).select(
            F.col("leader").alias("a"), F.col("member").alias("b"), "sim").checkpoint(eager=True)]
    stats["splits"] = stats.get("splits", 0) + 1
    let_go(items.sparkSession)
    early_rows = early_rows or leaf_rows
    share = min(0.5, 0.8 * early_rows / n)  # about so many, rather fewer
    last = items.select(F.col("v").cast("double").alias("v")).approxQuantile("v", [share], 0.1 * share)[0]
    early, late = items.where(F.col("v") <= last), items.where(F.col("v") > last)
    n_early = early.count()
    if n_early == n:  # nothing above it: part before the last position instead
        last = items.agg(F.max("v")).first()[0]
        early, late, n_early = items.where(F.col("v") < last), items.where(F.col("v") == last), n - 1
    parts = _lead(early, n_early, threshold, sparse, leaf_rows, hold_rows, stats)
    leaders = _without(early, _union(parts, items)) if parts else early
    claimed = claimed_by(late, n - n_early, leaders, leaders.count(), threshold, sparse, hold_rows, stats)
    let_go(items.sparkSession)
    rest = _without(late, claimed)
    return [*parts, claimed, *_lead(rest, rest.count(), threshold, sparse, leaf_rows, hold_rows, stats, 2 * early_rows)]


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.sparkSession.createDataFrame([], _schema(like))
    for p in parts:
        out = out.unionByName(p)
    return out


def group_corpus(vertices: DataFrame, threshold: float, pos: str = "pos", sparse: bool = True, leaf_rows: int | None = None,
                 hold_rows: int | None = None, stats: dict | None = None) -> DataFrame:
    """``a, b, sim``: (leader, member) rows of the greedy grouping of one corpus.

    ``vertices`` hold a numeric ``pos`` and either ``idx``, ``cnt``, ``sq`` (sparse counts) or ``vector``.
    ``stats``: ``copied_rows`` shuffled to block pairs, ``edges`` and ``splits``. An empty table gives no rows.
    """
    stats = {} if stats is None else stats
    items = _payload(vertices, pos, sparse)
    parts = _lead(items, items.count(), threshold, sparse, leaf_rows or LEAF_ROWS[sparse], hold_rows or HOLD_ROWS[sparse], stats)
    return _union(parts, items)


def group_onto(new: DataFrame, leaders: DataFrame, threshold: float, pos: str = "pos", sparse: bool = True,
               leaf_rows: int | None = None, hold_rows: int | None = None, stats: dict | None = None) -> DataFrame:
    """(leader, member) rows of items appended to a grouped corpus: only new x leaders and new x new are compared.

    ``leaders``: the earlier items that no other leads, all at positions before the new ones. Both are read more than once.
    """
    stats = {} if stats is None else stats
    hold = hold_rows or HOLD_ROWS[sparse]
    items, held = _payload(new, pos, sparse), _payload(leaders, pos, sparse)
    n, n_held = items.count(), held.count()
    parts = []
    if n and n_held:
        parts = [claimed_by(items, n, held, n_held, threshold, sparse, hold, stats)]
        items = _without(items, parts[0])
        n = items.count()
    parts += _lead(items, n, threshold, sparse, leaf_rows or LEAF_ROWS[sparse], hold, stats)
    return _union(parts, items)
