"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items are lowered (A-Z only) and cut into words of ASCII letters, digits and everything beyond ASCII.
All items of a shard form one suffix automaton, built in a task. Documents stream through it: words
become numbers by their hash (unknown words end a match), and the automaton tracks the longest match
that ends at each word. Where that match holds a window (``window`` consecutive item words, or a whole
shorter item) the words of the window are hit.

Documents never move: one pass over them per shard of items, each with that shard's automaton, whose
words are bounded by ``SHARD_WORDS``; a benchmark of any size is a number of passes. An item longer
than a shard is cut into parts that overlap by a window less one word, so none is lost.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .automaton import SuffixAutomaton
from .common import Words, materialise, slices

# Words of the items of one automaton, which every task holds.
SHARD_WORDS = 200_000

_GAP = np.ones(256, bool)
_GAP[ord("0") : ord("9") + 1] = False
_GAP[ord("a") : ord("z") + 1] = False
_GAP[128:] = False


def _words(column: pa.Array) -> Words:
    return Words(column, lower=True, gap=_GAP)


class Matcher:
    """The automaton of a shard, the names of its items, and the hashes by which words get numbers."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words = _words(pa.array(texts, pa.string()))
        self.hashes, first, numbers = np.unique(words.hashes(0), return_index=True, return_inverse=True)
        self.checks = words.hashes(1)[first]
        cuts = words.first.tolist()
        items = [numbers[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
        self.ids, self.automaton = ids, SuffixAutomaton(window).build(items)
        self.shortest = self.automaton.shortest()

    def known(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of the words that an item holds, in runs long enough for a window."""
        none = np.empty(0, np.int64)
        if not len(self.hashes) or not len(words):
            return none, none
        hashes = words.hashes(0)
        number = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.flatnonzero(self.hashes[number] == hashes)
        if len(place):
            place = place[self.checks[number[place]] == words.hashes(1)[place]]
        if not len(place):
            return none, none
        number = number[place]
        # a row's words are apart from the next row's
        breaks = (np.diff(place) != 1) | (np.diff(words.row[place]) != 0)
        lengths = np.diff(np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(place)]]))
        keep = np.repeat(lengths >= self.shortest, lengths)
        return place[keep], number[keep]


def _pieces(batches: Iterator[pa.RecordBatch], window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Items in parts of at most ``shard_words`` words that overlap by a window less one word."""
    for batch in batches:
        ids, texts, sizes = [], [], []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
            words = _words(pa.array([text.as_py()], pa.string()))
            for low in range(0, max(len(words) - window + 1, min(len(words), 1)), shard_words):
                high = min(low + shard_words + window - 1, len(words))
                ids.append(item)
                texts.append(words.data[words.start[low] : words.end[high - 1]].tobytes().decode())
                sizes.append(high - low)
        yield pa.RecordBatch.from_pydict({"item": pa.array(ids, pa.string()), "text": pa.array(texts, pa.string()), "words": pa.array(sizes, pa.int64())})


def automata(items: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> DataFrame:
    """(shard, matcher), written: one pickled matcher for about ``shard_words`` words of items."""
    chosen = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    pieces = materialise(chosen.mapInArrow(lambda b: _pieces(b, window, shard_words), "item string, text string, words long"), "leak-items")
    total = pieces.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    shards = -(-total // shard_words)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(max(shards, 1))).cast("int"))

    def build(shard: pa.Table) -> pa.Table:
        matcher = Matcher(shard.column("item").to_pylist(), shard.column("text").to_pylist(), window)
        return pa.table({"shard": shard.column("shard").slice(0, 1), "matcher": pa.array([pickle.dumps(matcher)], pa.binary())})

    return materialise(dealt.groupBy("shard").applyInArrow(build, "shard int, matcher binary"), "leak-automata")


_SPANS = "array<struct<start:int,end:int,longest:int>>"
_FOUND = f"n_words long, spans {_SPANS}, items array<string>"


def _merged(old: list[tuple[int, int, int]], new: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for start, end, longest in sorted(old + new):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), max(out[-1][2], longest))
        else:
            out.append((start, end, longest))
    return out


def _pass(matcher, text: str, earlier: bool):
    """Add to each row the spans and items that one shard's automaton finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Matcher = pickle.loads(matcher.value)
        for batch in batches:
            whole = batch.append_column("_t", pc.struct_field(batch.column("row"), text))
            for part in slices(whole, "_t"):
                words = _words(part.column("_t"))
                rows = part.num_rows
                spans = [[(s["start"], s["end"], s["longest"]) for s in r] for r in part.column("spans").to_pylist()] if earlier else [[] for _ in range(rows)]
                items = [set(r) for r in part.column("items").to_pylist()] if earlier else [set() for _ in range(rows)]
                places, numbers = own.known(words)
                cuts = np.searchsorted(places, words.first)
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    base = int(words.first[r])
                    found = own.automaton.match(places[cuts[r] : cuts[r + 1]] - base, numbers[cuts[r] : cuts[r + 1]])
                    if found:
                        spans[r] = _merged(spans[r], [s[:3] for s in found])
                        items[r] |= {own.ids[i] for s in found for i in own.automaton.items_of(s[3])}
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(np.diff(words.first), pa.int64()),
                     pa.array([[{"start": a, "end": b, "longest": c} for a, b, c in r] for r in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("longest", pa.int32())]))),
                     pa.array([sorted(r) for r in items], pa.list_(pa.string()))],
                    names=["row", "n_words", "spans", "items"],
                )

    return run


def find_leaks(documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(row, n_words, spans, items), one row per document, whose columns ``row`` holds.

    ``spans`` are the word places inside any window, merged, each with the longest match in it;
    ``items`` the ids, as strings in order, of items with a window in the document. Null and empty texts
    have no words; null or wordless items have no window; an item without an id is named by
    the empty string; items repeated under one id count once. No items: no spans. Texts of any length are
    read whole. Repeated documents each get their row; other columns may have any name.
    """
    spark = documents.sparkSession
    row_type = documents.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    found, earlier = documents.select(F.struct("*").alias("row")), False
    built = automata(items, item_id, item_text, window, shard_words)
    for shard in sorted(r["shard"] for r in built.select("shard").collect()):
        matcher = spark.sparkContext.broadcast(built.where(F.col("shard") == shard).first()["matcher"])
        if earlier:
            found = materialise(found, "leaks")
        found, earlier = found.mapInArrow(_pass(matcher, text, earlier), f"row {row_type}, {_FOUND}"), True
    if not earlier:
        nothing = spark.sparkContext.broadcast(pickle.dumps(Matcher([], [], window)))
        found = found.mapInArrow(_pass(nothing, text, False), f"row {row_type}, {_FOUND}")
    return found


def _cleaned(text: str, most_words: int):
    """The text without the spans longer than ``most_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.append_column("_t", pc.struct_field(batch.column("row"), text))
            for part in slices(whole, "_t"):
                words, texts = _words(part.column("_t")), part.column("_t").to_pylist()
                for r, spans in enumerate(part.column("spans").to_pylist()):
                    gone = [s for s in spans if s["end"] - s["start"] > most_words]
                    if gone:
                        raw, at, kept = texts[r].encode(), 0, []
                        base, first = int(words.offsets[r]), int(words.first[r])
                        for s in gone:
                            kept.append(raw[at : int(words.start[first + s["start"]]) - base])
                            at = int(words.end[first + s["end"] - 1]) - base
                        texts[r] = b"".join([*kept, raw[at:]]).decode()
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def hit_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, most_words: int = 0, most_coverage: float = 0.5) -> DataFrame:
    """The documents, all columns, less what they share with the items.

    Spans of more than ``most_words`` words are cut from the text; documents of whose words more than the
    share ``most_coverage`` is hit go whole. Documents without a hit, nulls among them, stay as they are.
    """
    found = find_leaks(documents, items, text, item_id, item_text, window).where(hit_words() <= F.lit(most_coverage) * F.col("n_words"))
    row_type = documents.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    cleaned = found.mapInArrow(_cleaned(text, most_words), f"row {row_type}, text string")
    return cleaned.select(*[(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
