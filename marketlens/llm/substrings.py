"""Substring dedup: repeated word windows found with FM-indexes, one per shard.

Every window of words has a minimizer, the least hash of its 8-word grams. Runs of windows
with one minimizer form a segment, and equal windows share the minimizer, so a shard of
minimizers sees all occurrences of its windows. Equal segments are one text: the document
with the least id holds it, the windows of all later holders are repeats. What is left are
different segments under one minimizer: their words go to the shard, which builds a
compressed FM-index and streams the segments through backward search. The matching
statistic, cut at the window, gives the run of all occurrences and its least document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, gram_hashes, materialise, mix64, signed, slices
from .fm_index import FmIndex

WINDOW = 50
GRAM = 8
# Symbols of one index; minimizers with more are indexed in parts, every two parts together.
INDEX_WORDS = 1_000_000
_P = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]
SEGMENT = "minimizer long, segment binary, doc_id long, version long, start int, windows int"


def _window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    least, span = grams, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                if len(words) < window:
                    continue
                hashes = [words.hashes(0), words.hashes(1)]
                least = _window_minima(gram_hashes(hashes[0], GRAM), window - GRAM + 1)
                row = words.row[: len(least)]
                inside = row == words.row[window - 1 :]
                fresh = inside.copy()
                fresh[1:] &= (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
                start = np.flatnonzero(fresh)
                if not len(start):
                    continue
                stop = np.append(start[1:], len(least))
                valid = np.append(0, np.cumsum(inside))
                count = valid[stop] - valid[start]
                end = start + count + window - 1
                names = np.empty((len(start), 2), np.uint64)
                for k in (0, 1):
                    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), _P[k])]))
                    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), _inverse(_P[k]))]))
                    sums = np.append(np.uint64(0), np.cumsum(hashes[k] * powers[:-1]))
                    names[:, k] = mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
                of = row[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(least[start])),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(start), [None, pa.py_buffer(names.tobytes())]).cast(pa.binary()),
                     part.column("doc_id").take(pa.array(of)), part.column("version").take(pa.array(of)),
                     pa.array((start - words.first[of]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["minimizer", "segment", "doc_id", "version", "start", "windows"],
                )

    return run


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by minimizer, segment and document: ``repeat`` rows, held by a later
    document, and the first holder's rows where other segments share the minimizer."""
    minimizer, segment, holder, several = None, None, None, False
    held: list[tuple] = []
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    names = ["minimizer", "segment", "doc_id", "version", "start", "windows", "repeat"]
    for batch in batches:
        keys = batch.column("minimizer").to_numpy()
        same = np.zeros(len(keys), bool)
        same[1:] = keys[1:] == keys[:-1]
        maybe = same.copy()
        maybe[:-1] |= same[1:]
        if len(keys):
            maybe[0] = maybe[-1] = True
        part = batch.filter(pa.array(maybe))
        out: list[tuple] = []
        for r in zip(*(part.column(c).to_pylist() for c in names[:-1]), strict=True):
            if r[0] != minimizer:
                minimizer, segment, holder, several, held = r[0], r[1], r[2], False, []
            elif r[1] != segment:
                segment, holder = r[1], r[2]
                if not several:
                    out += held
                    several, held = True, []
            if r[2] != holder:
                out.append((*r, True))
            elif several:
                out.append((*r, False))
            else:
                held.append((*r, False))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _contents(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                hashes = words.hashes(0)
                rows = []
                for r, wanted in enumerate(part.column("wanted").to_pylist()):
                    for w in wanted:
                        low = words.first[r] + w["start"]
                        rows.append((w["minimizer"], w["segment"], part.column("doc_id")[r].as_py(), hashes[low : low + w["windows"] + window - 1].tobytes()))
                if rows:
                    a, b, c, d = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"minimizer": pa.array(a, pa.int64()), "segment": pa.array(b, pa.binary()), "doc_id": pa.array(c, pa.int64()), "words": pa.array(d, pa.binary())})

    return run


def _search(window: int, index_words: int):
    """Rows sorted by minimizer to (segment, offset, windows): windows an earlier document holds."""

    def earlier(rows: list[tuple]) -> Iterator[tuple]:
        owners = np.array([r[2] for r in rows], np.int64)
        index = FmIndex([np.frombuffer(r[3], np.uint64) for r in rows], owners, window)
        for r, least in zip(rows, index.least_owners(np.arange(len(rows))), strict=True):
            hit = np.flatnonzero(np.diff(np.concatenate([[0], (least < r[2]).astype(np.int8), [0]])))
            yield from ((r[1], int(a), int(b - a)) for a, b in zip(hit[::2], hit[1::2], strict=True))

    def parts(group: list[tuple]) -> Iterator[list[tuple]]:
        """Whole when small; else every two halves-of-the-bound together."""
        if sum(len(r[3]) for r in group) <= 8 * index_words:
            yield group
            return
        pieces, size = [[]], 0
        for r in group:
            if size + len(r[3]) > 4 * index_words and pieces[-1]:
                pieces.append([])
                size = 0
            pieces[-1].append(r)
            size += len(r[3])
        yield from (pieces[i] + pieces[j] for i in range(len(pieces)) for j in range(i + 1, len(pieces)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]):
            for part in parts(rows) if rows else ():
                if found := list(earlier(part)):
                    a, b, c = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict({"segment": pa.array(a, pa.binary()), "offset": pa.array(b, pa.int32()), "windows": pa.array(c, pa.int32())})

        waiting, group, size, last = [], [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("minimizer", "segment", "doc_id", "words")), strict=True):
                if r[0] != last:
                    if size > 8 * index_words:
                        yield from emit(waiting)
                        yield from emit(group)
                        waiting, group, size = [], [], 0
                    elif sum(len(x[3]) for x in waiting) + size > 8 * index_words:
                        yield from emit(waiting)
                        waiting, group, size = group, [], 0
                    else:
                        waiting += group
                        group, size = [], 0
                    last = r[0]
                group.append(r)
                size += len(r[3])
        if size > 8 * index_words:
            yield from emit(waiting)
            waiting = []
        if waiting + group:
            yield from emit(waiting + group)

    return run


def _kept(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"] + (["kept_text"] if with_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                totals, removed, digests, spans, texts = [], [], [], [], []
                for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    words = text.encode("utf-8", "surrogatepass").split()
                    kept, at, gone, merged = [], 0, 0, []
                    for r in sorted(ranges or (), key=lambda r: (r["low"], r["high"])):
                        if merged and r["low"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], r["high"])
                        else:
                            merged.append([r["low"], r["high"]])
                    for low, high in merged:
                        kept += words[at:low]
                        at, gone = high, gone + high - low
                    body = b" ".join(kept + words[at:] if merged else words)
                    totals.append(len(words))
                    removed.append(gone)
                    digests.append(hashlib.sha256(body).hexdigest())
                    spans.append([{"low": a, "high": b} for a, b in merged])
                    texts.append(body.decode("utf-8", "surrogatepass") if with_text else None)
                columns = [part.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests),
                           pa.array(spans, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts)] if with_text else []), names=names)

    return run


def drop_repeats(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    with_text: bool = True, index_words: int = INDEX_WORDS,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept_text), one row per document.

    A word goes when a window of ``window`` words that covers it also starts in a document
    with a smaller id. ``spans`` are the removed word ranges. Null and short texts keep all.
    Rows with one id are not earlier than each other; rows without an id neither lose words
    nor take them from others.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    segments = docs.where("doc_id is not null").select("doc_id", "version", "text").mapInArrow(_segments(window), SEGMENT)
    ordered = segments.repartition(F.col("minimizer")).sortWithinPartitions("minimizer", "segment", "doc_id")
    sorted_out = materialise(ordered.mapInArrow(_sorted_out, SEGMENT + ", repeat boolean"), "substring-segments")

    holders = sorted_out.where("not repeat").groupBy("segment").agg(F.min(F.struct("doc_id", "version", "start", "windows", "minimizer")).alias("h"))
    wanted = materialise(
        holders.groupBy("h.doc_id", "h.version").agg(F.collect_list(F.struct("h.minimizer", "segment", "h.start", "h.windows")).alias("wanted")),
        "substring-wanted",
    )
    contents = docs.join(wanted, ["doc_id", "version"]).select("doc_id", "text", "wanted")
    words = contents.mapInArrow(_contents(window), "minimizer long, segment binary, doc_id long, words binary").dropDuplicates(["segment"])
    found = (
        words.repartition(F.col("minimizer")).sortWithinPartitions("minimizer", "segment")
        .mapInArrow(_search(window, index_words), "segment binary, offset int, windows int")
    )
    found = materialise(found, "substring-found")

    low = F.col("start")
    whole = sorted_out.where("repeat").select("doc_id", "version", low.alias("low"), (low + F.col("windows") + (window - 1)).alias("high"))
    partly = (
        sorted_out.where("not repeat").select("segment", "doc_id", "version", "start")
        .join(found, "segment")
        .select("doc_id", "version", (low + F.col("offset")).alias("low"), (low + F.col("offset") + F.col("windows") + (window - 1)).alias("high"))
    )
    ranges = whole.unionByName(partly).groupBy("doc_id", "version").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    joined = docs.join(ranges, ["doc_id", "version"], "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<low:int,high:int>>"
    return joined.mapInArrow(_kept(window, with_text), schema + (", kept_text string" if with_text else ""))
