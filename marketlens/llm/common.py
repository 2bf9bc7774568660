"""Helpers the operators of this subpackage share: words, hashes, scratch tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.scratch import scratch_path

WORD_GAP = r"[\x20\x09-\x0D]+"
# Tables of at most this many rows are broadcast; the count is taken first.
BROADCAST_ROWS = 100_000
SLICE_BYTES = 1 << 20
# Rows of an Arrow batch while a table is written: texts are long.
BATCH_ROWS = 1_000
# Rows that the Parquet reader holds at a time within ``short_batches``.
READ_ROWS = 256


def words_of(text: Column) -> Column:
    """Words of a text: everything between runs of ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """For jobs run inside: rows are read from Parquet, and handed to Python, few at a time. No row is left out.

    The reader's buffers double until a whole batch of texts or lists fits. As blocks of tens of MB they make
    an executor's heap grow to several times what is in use, and it seldom shrinks again.
    """
    fewer = {"spark.sql.parquet.columnarReaderBatchSize": READ_ROWS, "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}
    before = {key: spark.conf.get(key) for key in fewer}
    for key, rows in fewer.items():
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        for key, rows in before.items():
            spark.conf.set(key, rows)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends, nothing is lost with an executor."""
    spark, schema, path = df.sparkSession, df.schema, scratch_path(df.sparkSession, label)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    del df
    # shuffle files go once the collectors of both sides have seen that nothing reads them
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete the folder of a table from ``materialise`` that nothing will read again."""
    files = written.inputFiles()
    if files:
        jvm = written.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(written.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table when counting shows it is within the bound; else leave it to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# --- words and hashes of a whole Arrow column, by numpy -------------------------------------

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_table(seed: int) -> np.ndarray:
    return mix64((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * seed)) * _MULTIPLIER)


_TABLES = [_byte_table(0), _byte_table(1)]
_FACTORS = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text (one row at least)."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(low, high - low)
        low = high


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when it is through, free memory that Arrow and the C library keep goes
    back to the system. Workers outlive their stages, and what earlier ones left adds to an executor's heap."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim is not None:
            trim(0)

    return whole


class Words:
    """Word places in the UTF-8 bytes of a string column.

    ``start``/``end`` are byte places, ``row`` the row of each word, ``first[r]:first[r+1]``
    the words of row r. Null rows have no words. ``gap`` marks the bytes between words, white
    space unless told otherwise; it is asked after letters are lowered.
    """

    def __init__(self, column: pa.Array, lower: bool = False, gap: np.ndarray = _GAP):
        column = pc.fill_null(column, "").cast(pa.large_string())
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        raw = buffers[2]
        data = np.frombuffer(raw, np.uint8)[low:high] if raw is not None else np.empty(0, np.uint8)
        self.offsets = offsets - low
        self.data = LOWER[data] if lower else data
        inside = ~gap[self.data]
        edges = self.offsets[:-1][self.offsets[:-1] < len(data)]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[edges] = False
        starts = inside & ~before
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        if len(data):
            after[-1] = False
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(column)), np.diff(self.first))
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """64-bit hash of each word; ``which`` selects one of two independent functions."""
        if not len(self):
            return np.empty(0, np.uint64)
        lengths = self.end - self.start
        heads = np.zeros(len(self), np.int64)
        np.cumsum(lengths[:-1], out=heads[1:])
        place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        powers = _powers(int(lengths.max()), _FACTORS[which])
        values = _TABLES[which][self.data[self.inside]]
        values *= powers[place]
        return mix64(np.add.reduceat(values, heads))


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every n consecutive values; the caller drops those that cross rows."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, np.uint64(seed + 1), np.uint64)
    for j in range(n):
        out *= _FACTORS[1]
        out += hashes[j : j + count]
    return mix64(out)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)
