"""Importance resampling towards a target: documents whose words look like the target's are likelier drawn.

Texts are lowered (A-Z only) and pre-tokenised by an untrained regex split, which returns words
with their offsets. A feature is a window of 1 to ``n`` consecutive words, cut from the text by the
offsets of its first and last word, gaps inside as one space. A feature's bucket is its CRC.
Bucket counts of all documents and of the target give a gain per bucket; a document's weight is
the sum of its features' gains. Noise hashed from the document's id turns weights into a sample
without replacement: the highest sums of weight and noise are drawn.

Texts are split once: their buckets are written, and counts and weights read that table. All of it is
read in short batches. The histogram has a fixed number of buckets, so the map tasks send at most one row
per bucket and the gains may be broadcast. Ranks come from one range partitioning, no task sorts all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from tokenizers import Regex, pre_tokenizers

from .common import materialise, short_batches, slices

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
# Features whose bucket a task remembers before it starts anew.
REMEMBERED = 500_000
_INNER = re.compile(GAP)
# The lists of a written table are bytes of little-endian integers: counts of this type, buckets of ``place_type``.
COUNT = np.dtype("<i4")


def place_type(buckets: int) -> np.dtype:
    """The narrowest integers that tell so many buckets apart."""
    return np.min_scalar_type(max(buckets - 1, 0)).newbyteorder("<")


def window_features(text: str, places: list[tuple[int, int]], n: int) -> Iterator[str]:
    """Windows of 1 to n consecutive words, given the words' offsets."""
    for size in range(1, n + 1):
        for (start, _), (_, end) in zip(places, places[size - 1 :], strict=False):
            yield text[start:end] if size == 1 else _INNER.sub(" ", text[start:end])


def _bucketed(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizers.Split(Regex(GAP), "removed")
        known: dict[str, int] = {}
        place = place_type(buckets)

        def bucket(feature: str) -> int:
            found = known.get(feature)
            if found is None:
                found = known[feature] = zlib.crc32(feature.encode()) % buckets
            return found

        for batch in batches:
            for part in slices(batch, "text"):
                n_words, places, counts = [], [], []
                for text in part.column("text").to_pylist():
                    lowered = (text or "").encode().lower().decode()
                    words = [place for _, place in split.pre_tokenize_str(lowered)]
                    features = Counter(window_features(lowered, words, n))
                    n_words.append(len(words))
                    places.append(np.fromiter(map(bucket, features), place, len(features)).tobytes())
                    counts.append(np.fromiter(features.values(), COUNT, len(features)).tobytes())
                if len(known) > REMEMBERED:
                    known.clear()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"), pa.array(n_words, pa.int64()),
                     pa.array(places, pa.binary()), pa.array(counts, pa.binary())],
                    names=["doc_id", "version", "n_words", "buckets", "counts"],
                )

    return run


def bucketed(texts: DataFrame, doc_id: str, text: str, n: int, buckets: int) -> DataFrame:
    """(doc_id, version, n_words, buckets, counts), written: the distinct features of each text.

    ``buckets`` and ``counts`` are lists of integers as bytes, which Spark reads and hands on as one value each.
    ``version`` is a hash of the text and tells rows with one id apart.
    """
    chosen = texts.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"), F.col(text).alias("text"))
    with short_batches(texts.sparkSession):
        return materialise(
            chosen.mapInArrow(_bucketed(n, buckets), "doc_id long, version long, n_words long, buckets binary, counts binary"),
            "resampling-features",
        )


def _integers(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """The integers of all rows of a column of ``bucketed``, in order."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            places, counts = _integers(batch.column("buckets"), place_type(buckets)), _integers(batch.column("counts"), COUNT)
            sums += np.bincount(places, counts, buckets).astype(np.int64)
        filled = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(sums[filled])], names=["bucket", "n"])

    return run


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences per bucket over all texts: a table of fixed size, so it may come to the driver."""
    cells = features.select("buckets", "counts").mapInArrow(_counted(buckets), "bucket long, n long")
    sums = cells.groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    with short_batches(features.sparkSession):
        for row in sums.collect():
            out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, per bucket."""
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (int(source.sum()) + len(source)) / ((s + 1) * (int(target.sum()) + len(target)))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def _weighed(gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column("counts")).to_numpy(zero_copy_only=False) // COUNT.itemsize
            ends = np.cumsum(np.concatenate([[0], lengths]))
            places = _integers(batch.column("buckets"), place_type(len(gain.value)))
            values = _integers(batch.column("counts"), COUNT).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (values, values * gain.value[places])]
            n_features, weight = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "version", "n_words")), pa.array(n_features), pa.array(weight)],
                names=["doc_id", "version", "n_words", "n_features", "weight"],
            )

    return run


def weigh(documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, version, n_words, n_features, weight), one row per document.

    Null and empty texts have no features and weigh 0. Texts of any length are read whole; repeated
    rows count as often as they stand. An empty target gives gains against an even spread, an
    empty table of documents no rows. Other columns, of any name, are not read.
    """
    features = bucketed(documents, doc_id, text, n, buckets)
    wanted = bucketed(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text, n, buckets)
    gain = documents.sparkSession.sparkContext.broadcast(gains(histogram(features, buckets), histogram(wanted, buckets)))
    return features.mapInArrow(_weighed(gain), "doc_id long, version long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of seed and id; a null id is empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``weighed`` with score and rank; rank is null for documents not drawn.

    Of the N documents with at least ``least_words`` words the ``percent * N // 100`` highest scores
    are drawn; ties go to the smaller id, null ids last, rows equal in both in any order.
    """
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("n_words") >= least_words)
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id")]
    # the number of a row holds its partition (upper bits) and its place there
    sorted_rows = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    with short_batches(weighed.sparkSession):
        placed = materialise(sorted_rows, "resampling-order").withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    taken = placed.where("fit").count() * percent // 100
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(F.broadcast(before), "part").withColumn("rank", F.when(F.col("fit") & (rank <= taken), rank).cast("long"))
    return ranked.drop("at", "part", "before", "fit")


def resample(documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 10, least_words: int = 20, seed: int = 2024, n: int = 1) -> DataFrame:
    """The drawn documents, all columns. Of rows equal in id and text all that rank are kept."""
    drawn = draw(weigh(documents, target, doc_id, text, n=n), percent, least_words, seed).where("rank is not null")
    copies = drawn.groupBy("doc_id", "version").agg(F.count("*").alias("taken"))
    keyed = documents.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("v"))
    met = keyed.join(copies, keyed["d"].eqNullSafe(copies["doc_id"]) & (keyed["v"] == copies["version"]))
    nth = Window.partitionBy("d", "v").orderBy("d")
    return met.withColumn("nth", F.row_number().over(nth)).where("nth <= taken").select("row.*")
