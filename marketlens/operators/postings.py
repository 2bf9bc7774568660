"""Ranked keyword search over stored postings, skipping blocks that cannot reach the best scores.

An index is a table of posting lists, a folder per bucket of terms. Documents are dealt to segments by
hash of their id, and one row holds a term's documents in one segment, so the commonest word has as many
rows as there are segments and no row is longer than one. Within a segment documents of similar length
form a block, the same for all terms; with each list go the blocks' largest score parts.

A search reads only the folders of its terms' buckets. The lists of a request's terms meet by segment:
blocks are visited from the largest sum of part bounds down, until no bound reaches the worst of the
best scores so far, which is carried from segment to segment.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import text
from ..sources.files import write_partitioned
from ..sources.scratch import discard, scratch_path
from .retrieval import BM25_B, BM25_K1, MAX_RESULTS, bm25_idf

SEGMENT_ROWS = 8_192
# Words of a segment, on average: one task holds a segment.
SEGMENT_WORDS = 4_000_000
BUCKETS = 64
# Segments whose lists one task holds for a request.
SEGMENTS_TOGETHER = 16
# Scores are rounded for the ranking; what could round up to the worst kept one is kept.
SLACK = 2e-6


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _part(tf, length, mean_length: float):
    """A term's score in a document, but for its rarity."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean_length))


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Places where a run of equal values begins."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for values in sorted_columns:
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _lists(mean_length: float):
    def run(rows: pa.Table) -> pa.Table:
        """The posting lists of one segment, from its rows (segment, id, length, words)."""
        length = rows["length"].to_numpy().astype(np.int64)
        ids = rows["id"].combine_chunks().dictionary_encode(null_encoding="encode")
        # a document is an id and a length; by length, so the blocks of a list stand in order
        documents, document = np.unique(length * len(ids.dictionary) + ids.indices.to_numpy(), return_inverse=True)
        lengths = documents // len(ids.dictionary)
        # documents of similar length: their score parts differ by their counts alone
        blocks = np.floor(4 * np.log2(lengths + 1)).astype(np.int32)
        split = [pc.split_pattern(chunk, " ") for chunk in rows["words"].chunks]
        words = pa.chunked_array([x.flatten() for x in split], pa.string()).dictionary_encode().unify_dictionaries()
        code = np.concatenate([c.indices.to_numpy() for c in words.chunks]).astype(np.int64)
        row = np.repeat(np.arange(len(length)), np.concatenate([pc.list_value_length(x).to_numpy() for x in split]))
        worded = length[row] > 0
        pairs, tf = np.unique(code[worded] * len(documents) + document[row[worded]], return_counts=True)
        term, at = pairs // len(documents), pairs % len(documents)
        part = _part(tf, lengths[at], mean_length)
        first, first_of_block = _starts(term), _starts(term, blocks[at])
        ends = pa.array(np.append(first, len(pairs)), pa.int32())
        block_ends = pa.array(np.append(np.searchsorted(first_of_block, first), len(first_of_block)), pa.int32())
        tops = np.maximum.reduceat(part, first_of_block) if len(part) else part
        names = ids.dictionary.take(pa.array(documents % len(ids.dictionary))).take(pa.array(at))
        lists = pa.ListArray.from_arrays
        return pa.table(
            {
                "term": words.chunk(0).dictionary.take(pa.array(term[first])),
                "segment": pa.array(np.full(len(first), rows["segment"][0].as_py()), pa.int32()),
                "block": lists(ends, pa.array(blocks[at])), "id": lists(ends, names), "part": lists(ends, pa.array(part)),
                "blocks": lists(block_ends, pa.array(blocks[at][first_of_block])), "tops": lists(block_ends, pa.array(tops)),
            }
        )

    return run


def write_index(docs: DataFrame, path: str, id_column: str, text_column: str, *, buckets: int = BUCKETS, segment_rows: int = SEGMENT_ROWS, segment_words: int = SEGMENT_WORDS) -> None:
    """Write ``path``/postings and ``path``/figures, replacing an index that is there.

    Rows with one id and one length count as one document; null texts are documents without words.
    Texts are split once, into shared scratch, and exchanged by segment; a task makes all lists of a segment.
    """
    spark = docs.sparkSession
    spaced = docs.select(F.col(id_column).alias("id"), F.coalesce(text.spaced(text_column), F.lit("")).alias("words"))
    gaps = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))
    scratch = scratch_path(spark, "posting-words")
    sized = spaced.select("id", F.when(F.col("words") == "", 0).otherwise(gaps + 1).alias("length"), "words")
    sized.write.parquet(scratch)
    split = spark.read.schema(sized.schema).parquet(scratch)
    sizes = split.select("id", "length").distinct()
    figures = sizes.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean_length")).first()
    words = split.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    segments = max(1, -(-figures["n"] // (segment_rows // 2)), -(-words // segment_words))
    placed = split.withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(segments)).cast("int"))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"term string, segment int, block array<int>, id array<{kind}>, part array<double>, blocks array<int>, tops array<double>"
    lists = placed.groupBy("segment").applyInArrow(_lists(figures["mean_length"]), schema)
    rows = lists.withColumn("bucket", _bucket(F.col("term"), buckets))
    write_partitioned(rows, f"{path}/postings", "bucket")
    discard(spark, scratch)
    # the schema is kept with the figures: an index without words has no file to tell it
    stored = spark.createDataFrame([(figures["n"], figures["mean_length"], buckets, rows.schema.json())], "n long, mean_length double, buckets int, schema string")
    stored.write.mode("overwrite").parquet(f"{path}/figures")


class Best:
    """The best documents of a request so far, and how many blocks were scored and skipped."""

    def __init__(self, limit: int):
        self.limit, self.ids, self.scores = limit, np.empty(0, object), np.empty(0)
        self.scored = self.skipped = 0

    def worst(self) -> float:
        """What a document must score to be kept."""
        return np.partition(self.scores, -self.limit)[-self.limit] - SLACK if len(self.scores) >= self.limit else -np.inf

    def _keep(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        self.ids, self.scores = ids, scores
        near = scores >= self.worst()
        self.ids, self.scores = ids[near], scores[near]

    def add(self, lists: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """The lists (rarity, blocks, tops, block of each entry, ids, parts) of one segment."""
        bounds: dict[int, float] = {}
        for rarity, blocks, tops, *_ in lists:
            for block, top in zip(blocks.tolist(), tops.tolist(), strict=True):
                bounds[block] = bounds.get(block, 0.0) + rarity * top
        order = sorted(bounds, key=bounds.get, reverse=True)
        for at, block in enumerate(order):
            worst = self.worst()
            if bounds[block] < worst:
                self.skipped += len(order) - at
                return
            self.scored += 1
            ids, parts = [], []
            for rarity, _, _, own, names, values in lists:
                low, high = np.searchsorted(own, [block, block + 1])
                ids.append(names[low:high])
                parts.append(rarity * values[low:high])
            names, where = np.unique(np.concatenate(ids), return_inverse=True)
            scores = np.bincount(where, np.concatenate(parts), len(names))
            near = scores >= worst
            self._keep(names[near], scores[near])


def search(spark: SparkSession, path: str, terms: DataFrame, id_column: str, *, limit: int = MAX_RESULTS) -> DataFrame:
    """``(request_id, id, score, rank)``: at most ``limit`` hits per request of ``terms(request_id, term)``.

    Terms that no document has add nothing; requests without a hit have no row.
    """
    figures = spark.read.parquet(f"{path}/figures").first()
    terms = terms.select("request_id", "term").filter("term is not null").distinct()
    asked = terms.select("term").distinct().withColumn("bucket", _bucket(F.col("term"), figures["buckets"]))
    # at most as many as the index has buckets
    wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    schema = T.StructType.fromJson(json.loads(figures["schema"]))
    postings = spark.read.schema(schema).parquet(f"{path}/postings").filter(F.col("bucket").isin(wanted))
    lists = postings.join(asked, ["bucket", "term"])
    rarity = lists.groupBy("term").agg(F.sum(F.size("id")).alias("df")).select("term", bm25_idf(F.lit(float(figures["n"])), F.col("df")).alias("idf"))
    met = lists.join(rarity, "term").join(terms, "term").withColumn("part_no", F.floor(F.col("segment") / SEGMENTS_TOGETHER))
    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    id_kind = met.schema["id"].dataType.elementType.simpleString()

    def meet(rows: pa.Table) -> pa.Table:
        best = Best(limit)
        rows = rows.sort_by("segment")
        lists: list = []
        segments, array = rows.column("segment").to_pylist(), lambda name, r: rows.column(name)[r].values.to_numpy(zero_copy_only=False)
        for r, segment in enumerate(segments):
            lists.append((rows.column("idf")[r].as_py(), *(array(c, r) for c in ("blocks", "tops", "block", "id", "part"))))
            if r + 1 == len(segments) or segments[r + 1] != segment:
                best.add(lists)
                lists = []
        request = pa.array([rows.column("request_id")[0].as_py()] * len(best.ids), rows.schema.field("request_id").type)
        return pa.table({"request_id": request, "id": pa.array(best.ids.tolist(), rows.schema.field("id").type.value_type), "score": pa.array(best.scores)})

    chosen = met.select("request_id", "part_no", "segment", "idf", "blocks", "tops", "block", "id", "part")
    found = chosen.groupBy("request_id", "part_no").applyInArrow(meet, f"request_id {kinds['request_id']}, id {id_kind}, score double")
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), id_column)
    ranked = found.select("request_id", F.col("id").alias(id_column), F.round("score", 6).alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit)
