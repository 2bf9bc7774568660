"""Texts to overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import strip

# Fixed values.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200


def chunk_windows(
    docs: DataFrame,
    text_column: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Fixed windows over texts without blank lines, in the JVM and without a shuffle.

    The text is cut once into strides; a window is one stride plus the head of
    the next, so the cost is linear in the text however long it is.
    """
    stride = size - overlap
    if overlap > stride:
        raise ValueError("overlap must not exceed half the chunk size")
    strides = F.regexp_extract_all(text_column, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda i: F.struct(
            i.alias("chunk_ix"),
            strip(
                F.concat(
                    F.get("_s", i), F.left(F.coalesce(F.get("_s", i + 1), F.lit("")), F.lit(overlap))
                )
            ).alias("chunk_text"),
        ),
    )
    length = F.length(text_column)
    # ceil((length - overlap) / stride), one window at least.
    count = F.greatest(F.ceil((length - overlap) / F.lit(stride)).cast("int"), F.lit(1))
    return (
        docs.filter(length > 0)
        .select(
            *[c for c in docs.columns if c != text_column],
            strides.alias("_s"),
            count.alias("_n"),
        )
        .select("*", F.inline(windows))
        .drop("_s", "_n")
        .filter("chunk_text <> ''")
    )


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """Half-open spans of paragraphs; each but the first starts with its blank line."""
    # Blank lines do not overlap: three newlines are one blank line and a newline.
    starts = [0]
    at = text.find("\n\n")
    while at >= 0:
        if at > 0:
            starts.append(at)
        at = text.find("\n\n", at + 2)
    ends = starts[1:] + [len(text)]
    return [(a, b) for a, b in zip(starts, ends) if b > a]


def merge_spans(
    spans: list[tuple[int, int]], size: int, overlap: int
) -> list[tuple[int, int]]:
    """Pack consecutive spans up to ``size``, starting each pack up to ``overlap`` back."""
    packs = []
    first = 0
    for i, (_, end) in enumerate(spans):
        start = spans[first][0]
        if first < i and end - start > size:
            packs.append((start, spans[i - 1][1]))
            done = spans[i - 1][1]
            while first < i and (
                done - spans[first][0] > overlap or end - spans[first][0] > size
            ):
                first += 1
    packs.append((spans[first][0], spans[-1][1]))
    return packs


def window_spans(text: str, start: int, end: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows over one long span; a run of newlines is never parted from what precedes it."""

    def cut_back(p: int, low: int) -> int:
        while low < p < end and text[p] == "\n":
            p -= 1
        return p

    def cut_forward(p: int) -> int:
        while p < end and text[p] == "\n":
            p += 1
        return p

    def unit_end(p: int) -> int:
        return cut_forward(p + 1) if p < end else end

    spans = []
    at = start
    while True:
        stop = end if end - at <= size else cut_back(at + size, at)
        if stop == at:  # one character and a newline run longer than a window
            stop = unit_end(at)
        spans.append((at, stop))
        if stop >= end:
            return spans
        following = unit_end(stop)
        back = max(stop - overlap, at + 1)
        if following - back > size:
            back = min(following - size, stop)
        at = min(cut_forward(back), stop)


def split_text(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Whole paragraphs packed into chunks; a paragraph of a chunk or more becomes windows."""
    if not text:
        return []
    if "\n\n" not in text:
        spans = window_spans(text, 0, len(text), size, overlap)
    else:
        spans, short = [], []
        for a, b in paragraph_spans(text):
            if b - a < size:
                short.append((a, b))
                continue
            if short:
                spans += merge_spans(short, size, overlap)
                short = []
            spans += window_spans(text, a, b, size, overlap)
        if short:
            spans += merge_spans(short, size, overlap)
    return [c for c in (text[a:b].strip() for a, b in spans) if c]


def chunk_paragraphs(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Paragraph-aware chunks, in Arrow batches next to the scan; no shuffle."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, index, chunks = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                parts = split_text(text, size, overlap)
                owner += [row] * len(parts)
                index += range(len(parts))
                chunks += parts
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(index, pa.int32()),
                    pa.array(chunks, pa.string()),
                ],
                names=[id_column, "chunk_ix", "chunk_text"],
            )

    return docs.select(id_column, text_column).mapInArrow(
        split, f"{id_column} {id_type}, chunk_ix int, chunk_text string"
    )
