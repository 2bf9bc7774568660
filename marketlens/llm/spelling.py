"""Spelling variants of a corpus vocabulary: words one edit apart, and the form each is a slip of.

Words become vectors of letter counts. An edit moves such a vector little: an inserted or deleted
letter gives squared distance 1, a replaced one 2. Words of one length and one coarse count (letters
of each of three classes) form a block; an edit leads to the same block or to one of twelve others.
NumPy multiplies the letter counts of two adjacent blocks, which gives all squared distances at
once; pairs at most two apart are kept and their edit is verified letter by letter.

The vocabulary is a table: counted per task, summed by word. Crowded blocks are cut into parts, and a
task holds two parts. Each pair of blocks meets once, so each pair of words is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, slices, small

#: Letters of a word: fixed values of the pattern [A-Za-z\\u00C0-\\u00FF]+, upper-case ASCII lowered.
ALPHABET = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
CLASSES = 3
# Letters of all words of one part of a block, and distances in one product.
PART_LETTERS = 40_000
PRODUCT = 2_000_000
# Words a task counts before it hands them on.
COUNTED = 300_000


def _counted(least: int, slip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(rf"[a-zÀ-ÿ]{{{least},}}")
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(runs.findall((text or "").encode().lower().decode())).items():
                        if slip:
                            h = zlib.crc32(word.encode(), start)
                            if h % slip == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least:
                                    continue
                        total[word] += n
                if len(total) > COUNTED:
                    yield flush()
        yield flush()

    return run


def vocabulary(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, min_count: int = 5, slip: int = 0) -> DataFrame:
    """(word, n): runs of letters, A-Z lowered, of at least ``least`` code points and ``min_count`` occurrences.

    With ``slip``, a run loses a letter in documents where that number divides the CRC of
    ``<doc_id>:<run>``; a null id is empty text. Null texts have no runs; texts of any length are read
    whole; repeated rows count as often as they stand.
    """
    if least < 1:
        raise ValueError("a word has at least one letter")
    chosen = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    counts = chosen.mapInArrow(_counted(least, slip), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _class_sizes(word: Column) -> list[Column]:
    """How many letters of each class (code point modulo CLASSES) a word has."""
    letters = ["".join(c for c in ALPHABET if ord(c) % CLASSES == k) for k in range(CLASSES)]
    return [F.length(word) - F.length(F.translate(word, cls, "")) for cls in letters]


def _shifts() -> list[tuple[int, ...]]:
    """What an edit does to a block's class sizes: nothing, one letter more, or one changing class.

    Of each shift and its opposite one is listed: blocks meet once.
    """
    unit = np.eye(CLASSES, dtype=int)
    return [tuple(s.tolist()) for s in ([np.zeros(CLASSES, int)] + list(unit) + [unit[j] - unit[i] for i, j in combinations(range(CLASSES), 2)])]


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _letter_counts(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    rows, width = len(codes), len(letters)
    places = np.searchsorted(letters, codes) + np.arange(rows)[:, None] * width
    return np.bincount(places.ravel(), minlength=rows * width).reshape(rows, width)


def close_pairs(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of rows (code points) whose letter counts are at squared distance two or less."""
    letters = np.unique(np.concatenate([one.ravel(), two.ravel()]))
    # products stay exact: their terms are below the largest whole number of the type
    kind = np.float32 if max(one.shape[1], two.shape[1]) < 1024 else np.float64
    a, b = _letter_counts(one, letters).astype(kind), _letter_counts(two, letters).astype(kind)
    size_a, size_b = (a * a).sum(axis=1, keepdims=True), (b * b).sum(axis=1, keepdims=True)
    right = np.hstack([b, np.ones_like(size_b), size_b]).T
    left = np.hstack([2 * a, -size_a, -np.ones_like(size_a)])
    step = max(1, PRODUCT // len(two))
    for low in range(0, len(one), step):
        found = np.flatnonzero((left[low : low + step] @ right).ravel() >= -2)
        yield found // len(two) + low, found % len(two)


def one_edit(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For rows of equal number: do they differ by one replaced or, if ``two`` is a letter longer, one inserted code point?"""
    if one.shape[1] == two.shape[1]:
        return (one != two).sum(axis=1) == 1
    head = np.logical_and.accumulate(one == two[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((one == two[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= one.shape[1]


def _near(block: pa.Table) -> pa.Table:
    """Both directions of every near pair between the two sides of a pair of parts."""
    right = block.column("side").to_numpy() == 1
    within = not right.any()  # a part with itself: its pairs stand once above the diagonal
    sides = [block.filter(pa.array(~right)), block.filter(pa.array(~right if within else right))]
    words = [s.column("word").to_pylist() for s in sides]
    counts = [s.column("n").to_numpy() for s in sides]
    out: list[list[np.ndarray]] = [[], [], []]
    if all(words):
        codes = [_codes(w) for w in words]
        names = [np.array(w, object) for w in words]
        for i, j in close_pairs(*codes):
            if within:
                i, j = i[i < j], j[i < j]
            near = one_edit(codes[0][i], codes[1][j])
            i, j = i[near], j[near]
            for column, x, y in ((0, names[0][i], names[1][j]), (1, names[1][j], names[0][i]), (2, counts[1][j], counts[0][i])):
                out[column] += [x, y]
    columns = [np.concatenate(c).tolist() if c else [] for c in out]
    return pa.table({"word": pa.array(columns[0], pa.string()), "near": pa.array(columns[1], pa.string()), "n_near": pa.array(columns[2], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, n_near) for the written words(word, n): all pairs one edit apart, both ways.

    n_near is the near word's n. Words are distinct and of letters of ALPHABET.
    """
    sizes = [f"c{k}" for k in range(CLASSES)]
    blocked = words.withColumns(dict(zip(sizes, _class_sizes(F.col("word")), strict=True)))
    letters = sum((F.col(c) for c in sizes[1:]), F.col(sizes[0]))
    blocks = materialise(
        blocked.groupBy(*sizes).agg(F.count("*").alias("rows")).select(*sizes, F.ceil(F.col("rows") * letters / PART_LETTERS).cast("int").alias("parts")),
        "spelling-blocks",
    )
    # routes at the level of blocks: which parts meet which, on which side
    left = blocks.withColumn("shift", F.explode(F.array(*[F.array(*map(F.lit, s)) for s in _shifts()])))
    other = [F.col(c) + F.col("shift")[k] for k, c in enumerate(sizes)]
    adjacent = left.select(F.struct(*sizes).alias("a"), F.struct(*[o.alias(c) for o, c in zip(other, sizes, strict=True)]).alias("b"), F.col("parts").alias("parts_a")).join(
        blocks.select(F.struct(*sizes).alias("b"), F.col("parts").alias("parts_b")), "b"
    )
    met = adjacent.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    met = met.where((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j")))
    twice = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    ends = F.when(twice, F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block"), F.col("i").alias("part")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block"), F.col("i").alias("part")), F.struct(F.lit(1).alias("side"), F.col("b").alias("block"), F.col("j").alias("part")))
    )
    routes = materialise(met.select("a", "b", "i", "j", F.explode(ends).alias("e")).select("a", "b", "i", "j", "e.side", "e.block", "e.part"), "spelling-routes")

    parts = blocks.select(F.struct(*sizes).alias("block"), "parts")
    placed = blocked.select("word", "n", F.struct(*sizes).alias("block")).join(small(parts), "block")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts").cast("long")).cast("int")).drop("parts")
    routed = placed.join(small(routes), ["block", "part"])
    return routed.groupBy("a", "b", "i", "j").applyInArrow(_near, "word string, near string, n_near long")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) for the written links(word, form): the end of each chain of forms.

    Every round doubles the steps taken. A form stands more than once as often as its word, so chains are
    short and without rings.
    """
    roots = links.withColumnRenamed("form", "root")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(roots.join(small(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of words(word, n).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that n is at least
    ``ratio`` (two or more) times the word's own, else null; ``root`` where following forms ends, the
    word itself if it has none. No words: no rows.
    """
    if ratio < 2:
        raise ValueError("forms must stand more often than their words")
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = F.min(F.struct((-F.col("n_near")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left").withColumn("good", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    formed = materialise(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("good"), F.col("best.near")).alias("form"), F.when(F.col("good"), -F.col("best.less")).alias("form_n")),
        "spelling-forms",
    )
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
