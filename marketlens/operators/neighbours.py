"""Exact nearest neighbours: corpus rows meet queries in matrix blocks, never as pairs of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import scratch_path

# Fixed value: how many neighbours a retrieval returns unless told otherwise.
DEFAULT_K = 4

# Bounds. A query matrix is broadcast up to this many values (64 MB of doubles);
# beyond it both sides are exchanged in blocks.
BROADCAST_VALUES = 8_000_000
BLOCK_ROWS = 32_768
# Tasks that groups of queries and items are dealt to, at most.
MOST_TASKS = 1_000
# A first sample of the corpus sets upper bounds; each further pass reads FAN times as much.
FIRST_ROWS = 262_144
FAN = 64
# Cells whose figures are broadcast; their number is known before.
BROADCAST_CELLS = 1_000_000
_CELLS_PER_STEP = 4_000_000
# Rows measured at once, and columns that bound a query before its first neighbours are known.
_MEASURED = 200_000
_THIN = 8_192


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.size % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``a`` to the same row of ``b`` (or to its only one)."""
    d = a - b
    return (d * d).sum(axis=1)


def rough_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of ``a`` to all of ``b`` by one product, and a bound of their error.

    Both sides are moved to the middle of ``b`` first, so the bound follows the spread of
    the rows and not their distance from zero.
    """
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    scale = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    return scale - 2.0 * (a @ b.T), scale * (4 * (a.shape[1] + 8) * np.finfo(float).eps)


class HalfDistances:
    """Half the squared distances of ``a`` to ``b``, less half the squared length of each row of ``a``,
    by one product: for one row of ``a`` they rank as the distances do.

    Both sides are moved to the middle of ``b`` first. The product is of single precision unless
    lengths forbid; ``error`` bounds, per row of ``a``, what it adds to a squared distance.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        middle = b.mean(axis=0)
        a, b = a - middle, b - middle
        self.own, lengths = (a * a).sum(axis=1), (b * b).sum(axis=1)
        kind = np.float32 if max(self.own.max(), lengths.max()) < 1e30 else np.float64
        self._left = np.column_stack([-a, np.ones(len(a))]).astype(kind)
        self._right = np.column_stack([b, lengths / 2]).astype(kind).T
        self.error = (self.own + lengths.max()) * (4 * (b.shape[1] + 8) * np.finfo(kind).eps) + 1e-30

    def rows(self, low: int, high: int) -> np.ndarray:
        return self._left[low:high] @ self._right

    def level(self, low: int, high: int, limits: np.ndarray) -> np.ndarray:
        """What no row within ``limits`` (squared distances) exceeds."""
        return ((limits - self.own[low:high] + self.error[low:high]) / 2).astype(self._left.dtype)[:, None]


def thin_bounds(rough: np.ndarray, count: int) -> np.ndarray:
    """Per row a value that at least ``count`` of its columns do not exceed, from every few columns."""
    thin = rough[:, :: max(1, rough.shape[1] // max(_THIN, 4 * count))]
    return np.partition(thin, count - 1, axis=1)[:, count - 1]


def pieces(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose counts sum to ``most`` or less, or of a single row."""
    ends, low = np.cumsum(counts), 0
    while low < len(counts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield low, high
        low = high


def places(rows: np.ndarray, sorted_rows: np.ndarray) -> np.ndarray:
    """The place of each of ``sorted_rows`` within its run of equal values, all of them from ``rows``."""
    return np.arange(len(sorted_rows)) - np.repeat(np.searchsorted(sorted_rows, rows), np.bincount(sorted_rows - rows[0], minlength=len(rows)))


class _Best:
    """The k smallest (distance, id) per query seen so far, none beyond the query's bound."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, skip_self: bool, bounds: np.ndarray | None = None):
        self.query_ids, self.queries, self.k, self.skip_self = query_ids, queries, k, skip_self
        self.sizes = np.zeros(len(query_ids), np.int64)
        self.distances, self.ids = np.empty((len(query_ids), k)), np.empty((len(query_ids), k), np.int64)
        # Distance to beat, per query: the bound until k neighbours are known.
        self.limits = np.full(len(query_ids), np.inf) if bounds is None else bounds.astype(float)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if len(ids) == 0 or len(self.query_ids) == 0:
            return
        half = HalfDistances(self.queries, vectors)
        order = np.argsort(ids, kind="stable") if self.skip_self else None
        step = max(1, _CELLS_PER_STEP // len(ids))
        for low in range(0, len(self.query_ids), step):
            high = min(low + step, len(self.query_ids))
            rough = half.rows(low, high)
            if self.skip_self:
                first, last = (np.searchsorted(ids, self.query_ids[low:high], side, order) for side in ("left", "right"))
                for i in np.flatnonzero(last > first):
                    rough[i, order[first[i] : last[i]]] = np.inf
            limits = self.limits[low:high]
            open_ = np.flatnonzero(np.isinf(limits)) if len(ids) > self.k else ()
            if len(open_):
                limits = limits.copy()
                limits[open_] = half.own[low + open_] + 2 * thin_bounds(rough[open_], self.k).astype(float) + half.error[low + open_]
            near = rough <= half.level(low, high, limits)
            for start, end in pieces(np.count_nonzero(near, axis=1), _MEASURED):
                i, j = np.divmod(np.flatnonzero(near[start:end]), len(ids))
                self._merge(low + start, low + end, low + start + i, ids[j], vectors[j])

    def _merge(self, low: int, high: int, places_: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Rows that may be among the nearest of queries ``low`` to ``high`` are measured again by plain difference."""
        exact = squared_distances(vectors, self.queries[places_])
        within = exact <= self.limits[places_]
        if self.skip_self:
            within &= ids != self.query_ids[places_]
        if not within.any():
            return
        held = np.arange(self.k) < self.sizes[low:high, None]
        owner = np.concatenate([low + np.nonzero(held)[0], places_[within]])
        distances = np.concatenate([self.distances[low:high][held], exact[within]])
        ids = np.concatenate([self.ids[low:high][held], ids[within]])
        order = np.lexsort((ids, distances, owner))
        owner, distances, ids = owner[order], distances[order], ids[order]
        rank = places(np.arange(low, high), owner)
        kept = rank < self.k
        self.distances[owner[kept], rank[kept]], self.ids[owner[kept], rank[kept]] = distances[kept], ids[kept]
        self.sizes[low:high] = np.minimum(np.bincount(owner - low, minlength=high - low), self.k)
        full = low + np.flatnonzero(self.sizes[low:high] == self.k)
        self.limits[full] = self.distances[full, self.k - 1]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = np.arange(self.k) < self.sizes[:, None]
        return np.repeat(self.query_ids, self.sizes), self.ids[held], self.distances[held]


_HITS = "query_id long, item_id long, distance double"


def _hits(kind, best: _Best):
    queries, items, distances = best.arrays()
    return kind(
        [
            pa.array(queries, pa.int64()),
            pa.array(items, pa.int64()),
            pa.array(distances, pa.float64()),
        ],
        names=["query_id", "item_id", "distance"],
    )


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The best k of the per-task winners; input is k rows per query and task."""
    order = Window.partitionBy("query_id").orderBy("distance", "item_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))


def _present(rows):
    """Rows of a batch or table that have a vector.

    Spark would compute a derived vector once more to filter on it.
    """
    return rows if rows.column("v").null_count == 0 else rows.filter(rows.column("v").is_valid())


def bounded_queries(q: DataFrame, values: int = BROADCAST_VALUES) -> pa.Table | None:
    """The query vectors ``(id, v)`` if they hold at most ``values`` numbers, else None.

    One row more than the bound is the most that is ever fetched.
    """
    head = q.filter("v is not null").limit(1).collect()
    width = len(head[0]["v"]) if head else 1
    bound = max(1, values // max(1, width))
    few = q.limit(bound + 1).toArrow()
    return _present(few) if few.num_rows <= bound else None


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    *,
    query_columns: tuple[str, str] = ("query_id", "embedding"),
    corpus_columns: tuple[str, str] = ("vec_id", "embedding"),
    skip_self: bool = False,
    broadcast_values: int = BROADCAST_VALUES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, item_id, distance, rank)`` of the k nearest under squared L2, ties by id.

    Few queries (at most ``block_rows``): their matrix is broadcast and each task scans its part of the corpus. A sample by
    hash of id, and then a larger one while that is needed, gives every query an upper bound, so
    the last scan returns about FAN times k rows per query, however many tasks there are.
    Many queries: ``block_join``.
    """
    if k < 1:
        raise ValueError("k must be positive")
    q = _vectors(queries, *query_columns)
    c = _vectors(corpus, *corpus_columns)
    few = bounded_queries(q, broadcast_values)
    # Many queries meet the corpus in tasks of both sides, however few tasks read the corpus.
    if few is None or few.num_rows > block_rows:
        return block_join(q, c, k, skip_self=skip_self, block_rows=block_rows)
    ids, matrix = few.column("id").to_numpy(), _matrix(few.column("v"))
    bounds, shares = None, sample_shares(c)
    for share in shares:
        part = c.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
        if bounds is None:  # few rows: few tasks return them
            part = part.repartition(-(-FIRST_ROWS // BLOCK_ROWS))
        bounds = _bounds(scan(part, ids, matrix, k, skip_self, bounds), ids, k, bounds)
    return top_k(scan(c, ids, matrix, k, skip_self, bounds), k)


def sample_shares(c: DataFrame) -> list[int]:
    """One row in how many each sample takes, the smallest sample first; none for a small corpus."""
    if c.limit(FIRST_ROWS + 1).count() <= FIRST_ROWS:
        return []
    total, shares = c.count(), [FAN]
    while total // shares[0] > FIRST_ROWS:
        shares.insert(0, shares[0] * FAN)
    return shares


def scan(c: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, skip_self: bool, bounds: np.ndarray | None = None) -> DataFrame:
    """What each task of the corpus ``(id, v)`` finds: at most k rows per query, none beyond its bound."""
    payload = c.sparkSession.sparkContext.broadcast((ids, matrix, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, bounds = payload.value
        best = _Best(ids, matrix, k, skip_self, bounds)
        for batch in map(_present, batches):
            best.add(batch.column(0).to_numpy(), _matrix(batch.column(1)))
        yield _hits(pa.RecordBatch.from_arrays, best)

    return c.mapInArrow(run, _HITS)


def _bounds(hits: DataFrame, ids: np.ndarray, k: int, bounds: np.ndarray | None) -> np.ndarray:
    """Per query the distance of its k-th hit, or the bound it had: as many rows as there are queries."""
    out = np.full(len(ids), np.inf) if bounds is None else bounds.copy()
    worst = top_k(hits, k).filter(F.col("rank") == k).select("query_id", "distance").toArrow()
    order = np.argsort(ids, kind="stable")
    for query, distance in zip(worst.column(0).to_numpy(), worst.column(1).to_numpy(), strict=True):
        low, high = np.searchsorted(ids, query, "left", order), np.searchsorted(ids, query, "right", order)
        places = order[low:high]
        out[places] = np.minimum(out[places], distance)
    return out


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add each vector's nearest pivot and the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_present, batches):
            if batch.num_rows == 0:
                continue
            vectors = _matrix(batch.column(1))
            cell = rough_distances(vectors, shared.value)[0].argmin(axis=1)
            reach = np.sqrt(squared_distances(vectors, shared.value[cell]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(cell.astype(np.int32)),
                    pa.array(reach),
                ],
                names=["id", "v", "cell", "reach"],
            )

    vector_type = df.schema["v"].dataType.simpleString()
    return df.mapInArrow(cells, f"id long, v {vector_type}, cell int, reach double")


def meet_in_blocks(routed: DataFrame, items: DataFrame, block_rows: int, meet, schema: str, tasks: int = 1) -> DataFrame:
    """Cogroup ``routed`` queries and ``items``, both with (id, cell, block), and apply ``meet`` to each group.

    A group is little data and much work, so the groups are dealt to ``tasks`` tasks, however few bytes they hold.

    Where many queries visit one block they are split into equal parts and the block's rows repeated
    for each, so a task holds about ``block_rows`` rows of a side. Items of a block that no query
    visits go nowhere.
    """
    keys = ["cell", "block"]
    loads = routed.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")
    left = routed.join(loads, keys).withColumn("part", part).drop("parts")
    right = items.join(loads, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = [*keys, "part"]
    left, right = (side.repartition(tasks, *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def tasks_for(queries: int, blocks: int, block_rows: int) -> int:
    """Tasks for the groups in which so many queries meet so many blocks: bounded, and several groups each beyond that."""
    return max(1, min(MOST_TASKS, blocks * -(-queries // block_rows)))


class _Cells:
    """Cells of the corpus: their pivots, rows, reach and number of blocks."""

    def __init__(self, pivots: np.ndarray, rows: np.ndarray, far: np.ndarray, block_rows: int):
        self.pivots, self.rows, self.far = pivots, rows, far
        self.blocks = -(-rows // block_rows)

    def first(self, ids: np.ndarray, gaps: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """The cell and block a query visits first: of the nearest cell whose blocks hold enough."""
        full = self.rows // self.blocks >= 2 * need
        cell = np.where(full, gaps, np.inf).argmin(axis=1) if full.any() else gaps.argmin(axis=1)
        return cell, ids % self.blocks[cell]

    def further(self, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, cell, block) of all that may hold a row within the bound, less the first visit.

        No row of a cell is nearer than the gap to its pivot less the cell's reach.
        """
        gaps, error = rough_distances(vectors, self.pivots)
        least = np.sqrt(np.maximum(gaps - error, 0)) - self.far * (1 + 1e-9)
        place, cell = np.nonzero(least <= np.sqrt(bounds)[:, None] * (1 + 1e-9))
        times = self.blocks[cell]
        place, cell = np.repeat(place, times), np.repeat(cell, times)
        block = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
        first_cell, first_block = self.first(ids, gaps, need)
        new = (cell != first_cell[place]) | (block != first_block[place])
        return place[new], cell[new], block[new]


def block_join(
    q: DataFrame, c: DataFrame, k: int, *, skip_self: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact k-nearest join of two large sides, in two phases.

    The corpus is cut into cells around pivots and a crowded cell into equal blocks. First
    every query visits one block near it, which bounds the distance of its k-th neighbour; the hits
    are written. Then it visits only blocks of cells that the triangle inequality leaves, and
    gets back only rows within its bound. Both sides of a task are bounded, each meeting is one
    matrix product.
    """
    spark = q.sparkSession
    q, c = q.filter("v is not null"), c.filter("v is not null")
    total = c.count()
    # More cells prune more; what the driver holds of them stays below the number of rows.
    wanted = max(1, min(-(-total // block_rows), math.isqrt(total) // 2))
    # Pivots are the ids with the smallest hash: spread out, and the same on every run.
    chosen = c.orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow()
    chosen = _present(chosen)
    if chosen.num_rows == 0:
        return spark.createDataFrame([], _HITS + ", rank int")
    pivots = _matrix(chosen.column("v"))
    c_cells = _assign(c, pivots)
    stats = c_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("far")).toArrow()
    order = stats.column("cell").to_numpy()
    cells = _Cells(pivots[order], stats.column("n").to_numpy(), stats.column("far").to_numpy(), block_rows)
    sizes = spark.createDataFrame(pa.table({"cell": stats.column("cell"), "at": pa.array(np.arange(len(order)), pa.int32()), "blocks": pa.array(cells.blocks, pa.int64())}))
    sizes = F.broadcast(sizes) if len(order) <= BROADCAST_CELLS else sizes
    items = c_cells.join(sizes, "cell").select("id", "v", F.col("at").alias("cell"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))

    need = k + (1 if skip_self else 0)
    tasks = tasks_for(q.count(), int(cells.blocks.sum()), block_rows)
    shared = spark.sparkContext.broadcast(cells)
    kind = q.schema["v"].dataType.simpleString()

    def routes(batch: pa.RecordBatch, place: np.ndarray, cell: np.ndarray, block: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        taken = batch.take(pa.array(place))
        return pa.RecordBatch.from_arrays(
            [taken.column("id"), taken.column("v"), pa.array(bounds[place]), pa.array(cell, pa.int32()), pa.array(block, pa.int32())],
            names=["id", "v", "bound", "cell", "block"],
        )

    def to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_present, batches):
            if batch.num_rows:
                cell, block = shared.value.first(batch.column("id").to_numpy(), rough_distances(_matrix(batch.column("v")), shared.value.pivots)[0], need)
                yield routes(batch, np.arange(batch.num_rows), cell, block, np.full(batch.num_rows, np.inf))

    def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_present, batches):
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                bounds = part.column("bound").to_numpy()
                yield routes(part, *shared.value.further(part.column("id").to_numpy(), _matrix(part.column("v")), bounds, need), bounds)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(left.column("id").to_numpy(), _matrix(left.column("v")), k, skip_self, left.column("bound").to_numpy())
        best.add(right.column("id").to_numpy(), _matrix(right.column("v")))
        return _hits(pa.Table.from_arrays, best)

    routed = f"id long, v {kind}, bound double, cell int, block int"
    first = meet_in_blocks(q.mapInArrow(to_first, routed), items, block_rows, meet, _HITS, tasks)
    if len(order) == 1 and cells.blocks[0] == 1:
        return top_k(first, k)
    path = scratch_path(spark, "first-hits")
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    bounds = top_k(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("bound"))
    bounded = q.join(bounds, "id", "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    others = meet_in_blocks(bounded.mapInArrow(to_others, routed), items, block_rows, meet, _HITS, tasks)
    return top_k(first.unionByName(others), k)
