"""Chunking against a slow, literal statement of the rule."""

import re

from hypothesis import given, settings, strategies as st

from marketlens.operators import chunks


def pack(pieces, size, overlap):
    """Pack pieces in order; a full pack is emitted and cut from the front to the overlap."""
    out, current, total = [], [], 0
    for piece in pieces:
        if current and total + len(piece) > size:
            out.append("".join(current))
            while current and (total > overlap or total + len(piece) > size):
                total -= len(current.pop(0))
        current.append(piece)
        total += len(piece)
    if current:
        out.append("".join(current))
    return out


def units(text):
    """Single characters, each with the newlines behind it; leading newlines stand alone."""
    return re.findall(r"^\n+|[^\n]\n*", text)


def slow(text, size, overlap):
    if "\n\n" not in text:
        return slow_long(text, size, overlap)
    parts = re.split("(\n\n)", text)
    paragraphs = [parts[0]] + [parts[i] + parts[i + 1] for i in range(1, len(parts), 2)]
    out, short = [], []
    for p in filter(None, paragraphs):
        if len(p) < size:
            short.append(p)
            continue
        out += pack(short, size, overlap)
        short = []
        out += slow_long(p, size, overlap)
    return out + pack(short, size, overlap)


def slow_long(text, size, overlap):
    out, short = [], []
    for u in units(text):
        if len(u) < size:
            short.append(u)
            continue
        out += pack(short, size, overlap)
        short = []
        out.append(u)
    return out + pack(short, size, overlap)


texts = st.text(alphabet="ab .\n", max_size=160) | st.lists(
    st.text(alphabet="xyz\n", max_size=25), max_size=8
).map("\n\n".join)


@settings(max_examples=1500, deadline=None)
@given(texts, st.sampled_from([(10, 2), (20, 4), (12, 6), (7, 3)]))
def test_split_text_follows_the_rule(text, shape):
    size, overlap = shape
    want = [c.strip() for c in slow(text, size, overlap)]
    assert chunks.split_text(text, size, overlap) == [c for c in want if c]


def test_chunk_counts(spark):
    lengths = [0, 1, 800, 999, 1000, 1001, 1800, 1801, 2600, 2601]
    df = spark.createDataFrame([(n, "x" * n) for n in lengths], "n int, t string")
    counts = {r[0]: r[1] for r in chunks.chunk_windows(df, "t").groupBy("n").count().collect()}
    want = {1: 1, 800: 1, 999: 1, 1000: 1, 1001: 2, 1800: 2, 1801: 3, 2600: 3, 2601: 4}
    assert counts == want
    for n in lengths:
        assert len(chunks.split_text("x" * n)) == want.get(n, 0)


def test_windows_equal_the_splitter_without_newlines(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(7345)) + "é😀" * 900
    df = spark.createDataFrame([(text,)], "t string")
    got = [r["chunk_text"] for r in chunks.chunk_windows(df, "t").orderBy("chunk_ix").collect()]
    assert got == chunks.split_text(text)
    # Windows cover the text: without the overlaps they spell it again.
    assert "".join([got[0]] + [c[200:] for c in got[1:]]) == text


def test_paragraph_chunks_keep_rows_and_order(spark):
    docs = [(1, "a" * 600 + "\n\n" + "b" * 600), (2, None), (3, ""), (4, "short")]
    df = spark.createDataFrame(docs, "id long, t string")
    rows = chunks.chunk_paragraphs(df, "id", "t").orderBy("id", "chunk_ix").collect()
    assert [(r[0], r[1], len(r[2])) for r in rows] == [(1, 0, 600), (1, 1, 600), (4, 0, 5)]
