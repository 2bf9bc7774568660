"""Approximate nearest neighbours: stable projections, a kd-tree, a chi-square stopping test.

Vectors are projected by a Gaussian matrix to a few dimensions; squared projected distance
over squared distance is then chi-square distributed. The projected space is cut like the
upper levels of a kd-tree (boundaries from a bounded sample, every row indexed); crowded cells
are dealt into several shards. A task builds the lower levels over its shard and verifies
projected neighbours in the order of their leaves, with exact distances, until the test says
that a nearer one is unlikely to be left.

A query visits its own cell first. The distance found there bounds the test in all other
cells: only those whose box passes it get the query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, mix64

DIMENSIONS = 8  # even: the chi-square distribution then has a closed form
CONFIDENCE = 0.98
SAMPLE_ROWS = 20_000
SHARD_ROWS = 4_096
LEAF_ROWS = 32
QUERY_BLOCK = 512
# Projections of equal vectors may differ by rounding: this share of their squared length is let pass.
ROUNDING = 1e-12
HIT = "query long, query_id long, vec_id long, d2 double"


def chi_square_bound(confidence: float, k: int) -> float:
    """The value a chi-square variable of an even number of degrees stays below with ``confidence``."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for j in range(1, k // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 10_000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < confidence else (low, middle)
    return high


def projection(width: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A Gaussian matrix that depends on its shape only."""
    bits = mix64(np.arange(1, 2 * width * dimensions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    half = width * dimensions
    return (np.sqrt(-2 * np.log(u[:half])) * np.cos(2 * np.pi * u[half:])).reshape(width, dimensions)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def split_space(points: np.ndarray, leaves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes of a kd-tree over a sample: halved at the median of the widest side, cells without an inside kept whole."""
    side = np.full(points.shape[1], np.inf)
    boxes = [(-side, side, points)]
    while len(boxes) < leaves:
        boxes.sort(key=lambda b: -len(b[2]))
        low, high, inside = boxes[0]
        if len(inside) < 2:
            break
        axis = int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))
        at = float(np.median(inside[:, axis]))
        left = inside[:, axis] < at
        if left.all() or not left.any():
            break
        high_left, low_right = high.copy(), low.copy()
        high_left[axis], low_right[axis] = at, at
        boxes[0:1] = [(low, high_left, inside[left]), (low_right, high, inside[~left])]
    return [(low, high) for low, high, _ in boxes]


def cell_of(points: np.ndarray, boxes) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    for k, (low, high) in enumerate(boxes):
        out[((points >= low) & (points < high)).all(axis=1)] = k
    return out


class KdTree:
    """Leaves of a kd-tree over projected points, with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        parts, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) > leaf_rows:
                inside = points[rows]
                axis = int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))
                order = np.argpartition(inside[:, axis], len(rows) // 2)
                todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
            else:
                parts.append(rows)
        self.rows = np.concatenate(parts)
        self.first = np.append(0, np.cumsum([len(p) for p in parts]))
        self.low = np.array([points[p].min(axis=0) for p in parts])
        self.high = np.array([points[p].max(axis=0) for p in parts])

    def nearness(self, query: np.ndarray) -> np.ndarray:
        """Squared projected distance from a query to every leaf's box."""
        gap = np.maximum(0.0, np.maximum(self.low - query, query - self.high))
        return (gap * gap).sum(axis=1)


def _verify(tree: KdTree, points, vectors, ids, query, image, own_id, k, bound, limit):
    """Verify leaves in the order of their projected distance, a few at first and more later,
    until no leaf left passes the test: projected distance above ``bound`` times the k-th distance."""
    slack = ROUNDING * (1.0 + float(image @ image))
    near = tree.nearness(image) - slack
    order = np.argsort(near, kind="stable")
    best_d, best_id = np.empty(0), np.empty(0, np.int64)
    reach, at, step = limit, 0, 2
    while at < len(order):
        leaves = order[at : at + step]
        leaves = leaves[near[leaves] <= bound * reach]
        if not len(leaves):
            break
        at, step = at + step, step * 2
        rows = np.concatenate([tree.rows[tree.first[v] : tree.first[v + 1]] for v in leaves])
        gap = points[rows] - image
        rows = rows[((gap * gap).sum(axis=1) - slack <= bound * reach) & (ids[rows] != own_id)]
        if not len(rows):
            continue
        difference = vectors[rows] - query
        d = np.append(best_d, (difference * difference).sum(axis=1))
        names = np.append(best_id, ids[rows])
        keep = np.lexsort((names, d))[:k]
        best_d, best_id = d[keep], names[keep]
        if len(best_d) == k:
            reach = min(reach, best_d[-1])
    return best_d, best_id


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("v"))
    return chosen.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
    dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): k nearest rows of ``vectors`` for each row of ``queries``.

    Score is the Euclidean distance of the original vectors in double precision; ties go to
    the smaller id. Rows with a query's id are not its neighbours. Null, zero and non-finite
    vectors, null ids, and vectors of another length than the most common one take no part.
    Repeated rows are candidates as often as they occur; a query repeated with the same vector
    is answered once. The sample only places the boundaries of cells.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, vec_id, vector)
    width = usable.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not width:
        return empty
    width = width[0]["w"]
    gauss, bound = projection(width, dimensions), chi_square_bound(confidence, dimensions)
    rows = usable.where(F.size("v") == width)
    asked = _usable(queries, vec_id, vector).where(F.size("v") == width).distinct()

    total = rows.count()
    share = min(1.0, 2.0 * sample_rows / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample_rows).select("v")
    sample = np.array([r.v for r in drawn.collect()], np.float64).reshape(-1, width) @ gauss
    boxes = split_space(sample, max(1, min(4096, -(-total // (shard_rows * 4))))) if len(sample) else [(np.full(dimensions, -np.inf), np.full(dimensions, np.inf))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                cells = cell_of(_matrix(part.column("v")) @ gauss, boxes)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(cells)], names=["vec_id", "v", "cell"])

    placed = materialise(rows.mapInArrow(place, "vec_id long, v array<double>, cell int"), "ann-placed")
    # a cell with many rows, equal ones included, is dealt into several shards
    shards = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    sizes = {r.cell: int(r.shards) for r in shards.collect()}  # one row per cell, at most 4096
    if not sizes:
        return empty
    count = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    numbers, shard_count = {}, 0
    for cell, n in sorted(sizes.items()):
        numbers[cell] = shard_count
        shard_count += n
    first = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    dealt = placed.select(
        "vec_id", "v", (first[F.col("cell")] + F.pmod(F.xxhash64("vec_id", "v"), count[F.col("cell")])).cast("int").alias("shard")
    )
    known = materialise(
        asked.mapInArrow(place, "vec_id long, v array<double>, cell int").select(F.monotonically_increasing_id().alias("query"), "vec_id", "v", "cell"),
        "ann-queries",
    )

    def answer(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [b for b in left if b.num_rows]
        if not index:
            return
        stored = np.concatenate([_matrix(b.column("v")) for b in index])
        ids = np.concatenate([b.column("vec_id").to_numpy() for b in index])
        points = stored @ gauss
        tree = KdTree(points)
        for batch in right:
            if not batch.num_rows:
                continue
            asked_vectors = _matrix(batch.column("v"))
            images = asked_vectors @ gauss
            out: list[list[np.ndarray]] = [[], [], [], []]
            numbers_ = batch.column("query").to_numpy()
            names = batch.column("vec_id").to_numpy()
            limits = batch.column("reach").to_numpy()
            for j in range(batch.num_rows):
                d, found = _verify(tree, points, stored, ids, asked_vectors[j], images[j], names[j], k, bound, limits[j])
                for column, values in zip(out, (np.full(len(d), numbers_[j]), np.full(len(d), names[j]), found, d), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in out], schema=pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("d2", pa.float64())])
            )

    def look(routed: DataFrame) -> DataFrame:
        return dealt.groupBy("shard").cogroup(routed.groupBy("shard")).applyInArrow(lambda a, b: _tables(answer, a, b), HIT)

    best = Window.partitionBy("query").orderBy("d2", "vec_id")

    def top(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # one shard of the query's own cell gives the first bound
    home = known.select(
        "query", "vec_id", "v", F.lit(float("inf")).alias("reach"),
        (first[F.col("cell")] + F.pmod(F.xxhash64("vec_id"), count[F.col("cell")])).cast("int").alias("shard"),
    ).where("shard is not null")
    at_home = materialise(top(look(home)), "ann-home")
    reach = at_home.groupBy("query").agg(F.max(F.when(F.col("rank") == k, F.col("d2"))).alias("d2"))
    lows = np.array([b[0] for b in boxes])
    highs = np.array([b[1] for b in boxes])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(low, QUERY_BLOCK)
                if not part.num_rows:
                    continue
                images = _matrix(part.column("v")) @ gauss
                gap = np.maximum(0.0, np.maximum(lows[None] - images[:, None], images[:, None] - highs[None]))
                slack = ROUNDING * (1.0 + (images * images).sum(axis=1))
                limit = bound * part.column("reach").to_numpy() + slack
                row, cell = np.nonzero((gap * gap).sum(axis=2) <= limit[:, None])
                targets = [(r, numbers[c] + s) for r, c in zip(row.tolist(), cell.tolist(), strict=True) if c in numbers for s in range(sizes[c])]
                if targets:
                    at, shard = zip(*targets, strict=True)
                    chosen = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [chosen.column(c) for c in ("query", "vec_id", "v", "reach")] + [pa.array(shard, pa.int32())], names=["query", "vec_id", "v", "reach", "shard"]
                    )

    bounded = known.join(reach, "query", "left").select("query", "vec_id", "v", F.coalesce("d2", F.lit(float("inf"))).alias("reach"))
    routed = bounded.mapInArrow(route, "query long, vec_id long, v array<double>, reach double, shard int")
    return top(look(routed)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d2").alias("score"))


def _tables(answer, left: pa.Table, right: pa.Table) -> pa.Table:
    """One cogroup: a shard of bounded size and the queries that visit it, in blocks."""
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("d2", pa.float64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    blocks = right.combine_chunks().to_batches(max_chunksize=QUERY_BLOCK)
    return pa.Table.from_batches(list(answer(iter(left.combine_chunks().to_batches()), iter(blocks))), schema)
