"""Embedding, retrieval and prompt assembly."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text, vectors
from ..sources.scratch import scratch_path

EMBEDDING_SIZE = 256
BM25_K1 = 1.2
BM25_B = 0.75
# Fixed value: most hits a search returns.
MAX_RESULTS = 50
# Most frequent words that keyword extraction broadcasts, and words a task counts before it hands them on.
FREQUENT_WORDS = 500_000
WORDS_TOGETHER = 300_000


def _places(words: pa.Array, size: int) -> np.ndarray:
    """A word's place is the number in the first eight digits of its MD5, modulo ``size``.

    Each distinct word of the batch is hashed once.
    """
    coded = words.dictionary_encode()
    places = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size for w in coded.dictionary.to_pylist()]
    return np.array(places, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)


def _counts(words: pa.ListArray, size: int) -> np.ndarray:
    """Occurrences per row and place; a null row has none."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(row * size + _places(words.flatten(), size), minlength=len(words) * size).reshape(len(words), size)


def embed_hash(df: DataFrame, text_column: str, size: int = EMBEDDING_SIZE, idf: Sequence[float] | None = None) -> DataFrame:
    """Unit vector of hashed word counts; the same text always gives the same vector.

    With ``idf``, a weight per place from ``fit_idf``, rare words count more. Texts without words
    get a vector of zeros, null texts no vector.
    """
    weights = np.ones(size) if idf is None else np.asarray(idf, float)
    if len(weights) != size:
        raise ValueError("idf has a weight for each place")

    @F.arrow_udf("array<float>")
    def embed(words: pa.Array) -> pa.Array:
        values = _counts(words, size) * weights
        norms = np.sqrt((values * values).sum(axis=1, keepdims=True))
        unit = np.divide(values, norms, out=np.zeros_like(values), where=norms > 0).astype(np.float32)
        offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * size)
        return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()), mask=words.is_null() if words.null_count else None)

    # said to vary, so that Spark does not repeat it where a filter reads the vector
    return df.withColumn("embedding", embed.asNondeterministic()(text.tokens(text_column)))


def fit_idf(df: DataFrame, text_column: str, size: int = EMBEDDING_SIZE) -> list[float]:
    """Weight per place, ln((n + 1) / (df + 1)) + 1: df texts of n have a word there. Null texts do not count.

    Each task sends one row per place.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            words = batch.column(0)
            seen += (_counts(words, size) > 0).sum(axis=0)
            rows += len(words) - words.null_count
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(size + 1)), "n": pa.array(np.append(seen, rows))})

    found = df.select(text.tokens(text_column)).mapInArrow(places, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    counts = dict(found.collect())
    return [math.log((counts.get(size, 0) + 1) / (counts.get(i, 0) + 1)) + 1 for i in range(size)]


def mean_vectors(items: DataFrame, label_column: str, vector_column: str) -> DataFrame:
    """Mean vector per label, summed in the map tasks first."""
    vector = array_to_vector(F.transform(vector_column, lambda x: x.cast("double")))
    return (
        items.select(label_column, vector.alias("_v"))
        .groupBy(label_column)
        .agg(Summarizer.mean(F.col("_v")).alias("_m"))
        .select(label_column, vector_to_array("_m").alias("embedding"))
    )


def cosine_filter(
    items: DataFrame, queries: DataFrame, on: str, threshold: float, *, decimals: int = 6
) -> DataFrame:
    """Items at least ``threshold`` similar to the query of their own topic."""
    similarity = F.round(vectors.cosine("embedding", "_query"), decimals)
    return (
        items.join(queries.withColumnRenamed("embedding", "_query"), on)
        .withColumn("similarity", similarity)
        .filter(F.col("similarity") >= threshold)
        .drop("_query")
    )


def retrieve_context(
    hits: DataFrame, chunks: DataFrame, *, separator: str = "\n\n"
) -> DataFrame:
    """The retrieved chunks of each query, best first, joined to one context."""
    return (
        chunks.join(hits, "item_id")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_text"))).alias("_c"))
        .select(
            "query_id",
            F.array_join(F.transform("_c", lambda c: c["chunk_text"]), separator).alias("context"),
            F.size("_c").alias("n_chunks"),
        )
    )


def canonical_force(requests: DataFrame, forces: DataFrame, column: str) -> DataFrame:
    """Conform a force name, whatever module it came from; a trailing "Force" is dropped."""
    named = F.lower(F.trim(F.element_at(F.split(column, "Force"), 1)))
    return requests.join(forces, named == F.col("alias"), "left").drop("alias")


def render_prompt(
    requests: DataFrame, forces: DataFrame, templates: DataFrame, column: str = "force_name",
    *, question: str | None = None, unknown: str = "error",
) -> DataFrame:
    """Fill the template of each request's force with its context.

    ``question`` names the column for the slot ``{question}``; what a context or a
    question holds is not filled again. A force without a template fails the job, or, with ``unknown='keep'``,
    leaves its prompt NULL.
    """
    joined = canonical_force(requests, forces, column).join(templates, "force", "left")
    parts = F.split("template", r"\{context\}")
    if question is not None:
        asked = F.coalesce(F.col(question), F.lit(""))
        parts = F.transform(parts, lambda p: F.replace(p, F.lit("{question}"), asked))
    prompt = F.call_function("array_join", parts, F.col("context"))
    if unknown == "error":
        message = F.concat(F.lit("Unknown force: "), F.coalesce(F.col(column), F.lit("NULL")))
        prompt = F.when(F.col("template").isNull(), F.raise_error(message)).otherwise(prompt)
    return joined.withColumn("prompt", prompt).drop("template")


def render_meta_prompt(ideas: DataFrame, force_names: list[str], template: str) -> DataFrame:
    """One crawl-planning prompt per idea and force."""
    # the idea goes in last: what it holds is not filled again
    with_force = F.replace(F.lit(template), F.lit("{porter_force}"), F.col("porter_force"))
    return ideas.withColumn(
        "porter_force", F.explode(F.array(*map(F.lit, force_names)))
    ).withColumn("prompt", F.replace(with_force, F.lit("{project_idea}"), F.col("idea")))


def query_terms(searches: DataFrame, text_column: str) -> DataFrame:
    return searches.select(
        "request_id", F.explode(F.array_distinct(text.tokens(text_column))).alias("term")
    )


def _bm25_part(tf: Column, length: Column, idf: Column, mean_length: Column) -> Column:
    return idf * tf * (BM25_K1 + 1) / (
        tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean_length)
    )


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def _best_hits(scored: DataFrame, id_column: str, limit: int) -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), id_column)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def bm25(
    docs: DataFrame,
    terms: DataFrame,
    id_column: str,
    text_column: str,
    *,
    limit: int = MAX_RESULTS,
) -> DataFrame:
    """Ranked keyword search, at most ``limit`` hits per request ``(request_id, term)``.

    One pass splits the text and keeps, in shared scratch, each document's length and its
    counts of words asked for. The words meet the terms in a join, which Spark broadcasts
    while the terms are small; corpus figures and scores come from the kept rows. A length
    row goes by a name no word can have, spread over the ids so that it makes no hot key.
    Rows with one id and one length count as one document.
    """
    spark = docs.sparkSession
    terms = terms.select("request_id", "term").distinct()
    size_row = F.concat(F.lit("#"), F.xxhash64(id_column).cast("string"))
    words = docs.select(
        id_column, F.coalesce(text.tokens(text_column), F.array().cast("array<string>")).alias("_t")
    ).select(id_column, F.size("_t").alias("length"), F.explode(F.array_append("_t", size_row)).alias("term"))
    asked = terms.select("term", F.lit(True).alias("asked")).filter("term is not null").distinct()
    kept = (
        words.join(asked, "term", "left")
        .filter(F.col("asked") | F.startswith("term", F.lit("#")))
        .groupBy(id_column, "length", "term")
        .agg(F.count("*").alias("tf"))
    )
    path = scratch_path(spark, "bm25")
    kept.write.parquet(path)
    kept = spark.read.schema(kept.schema).parquet(path)

    is_size = F.startswith("term", F.lit("#"))
    figures = kept.filter(is_size).agg(
        F.sum("tf").alias("n"), (F.sum(F.col("length") * F.col("tf")) / F.sum("tf")).alias("mean_length")
    ).first()
    n, mean_length = F.lit(float(figures["n"] or 0)), F.lit(figures["mean_length"] or 1.0)
    matches = kept.filter(~is_size)
    frequency = matches.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(frequency, "term").select(
        "request_id", "term", bm25_idf(n, F.col("df")).alias("idf")
    )
    part = _bm25_part(F.col("tf"), F.col("length"), F.col("idf"), mean_length)
    scored = (
        matches.join(weighted, "term")
        .groupBy("request_id", id_column)
        .agg(F.round(F.sum(part), 6).alias("score"))
    )
    return _best_hits(scored, id_column, limit)


def _row_counts(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, word, tf) of every distinct word of every row, rows ascending; and the words of the batch."""
    coded = words.flatten().dictionary_encode()
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    row = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    pairs, tf = np.unique(row * max(len(names), 1) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return pairs // max(len(names), 1), pairs % max(len(names), 1), tf, names


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task that hold each word, handed on whenever there are many words."""
    seen: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "df": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return out

    for batch in batches:
        _, word, _, names = _row_counts(batch.column(0))
        seen.update(dict(zip(names, np.bincount(word, minlength=len(names)).tolist(), strict=True)))
        if len(seen) > WORDS_TOGETHER:
            yield flush()
    yield flush()


def _candidates(known, n: int):
    """Per row the words that may be among its n best: by their score where ``known`` holds the word's
    frequency, else by the bounds that the most and the least frequent word not held allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, total, highest = known.value
        least, most = (math.log((total + 1) / (df + 1)) for df in (highest, 1))
        for batch in batches:
            row, word, tf, names = _row_counts(batch.column(1))
            df = np.array([frequency.get(w, 0) for w in names], np.int64)
            held = df > 0
            idf = np.log((total + 1) / (np.where(held, df, 1) + 1))
            low, high = (tf * np.where(held, idf, bound)[word] for bound in (least, most))
            order = np.lexsort((-low, row))
            heads = np.searchsorted(row, np.arange(batch.num_rows + 1))
            nth = np.minimum(heads[:-1] + n, heads[1:]) - 1  # the place of a row's n-th best, or its last
            limit = low[order][np.maximum(nth, 0)] if len(low) else np.zeros(batch.num_rows)
            few = np.diff(heads) < n
            keep = few[row] | (high >= limit[row] - 2e-6)
            where = word[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[keep])), pa.array(names, pa.string()).take(pa.array(where)), pa.array(tf[keep], pa.int64()),
                 pa.array(df[where], pa.int64(), mask=~held[where])],
                names=[batch.schema.names[0], "term", "tf", "known"],
            )

    return run


def keyword_extract(docs: DataFrame, id_column: str, text_column: str, n: int = 5, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """Top words of each document by TF-IDF; a row is a document, its id is its own.

    Words are counted within the row. The first pass sums how many documents hold each word, the tasks
    having combined their own. The ``frequent`` most frequent words are broadcast for the second: a
    word not among them is no more frequent than the last of them, which bounds its score, so only
    words that can be among a document's best are exchanged.
    """
    spark = docs.sparkSession
    words = docs.select(id_column, text.tokens(text_column).alias("_t"))
    path = scratch_path(spark, "word-frequencies")
    words.select("_t").mapInArrow(_document_counts, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).write.parquet(path)
    frequency = spark.read.parquet(path)
    top = frequency.orderBy(F.desc("df"), "term").limit(frequent).toArrow()
    total = docs.count()
    held = dict(zip(top.column("term").to_pylist(), top.column("df").to_pylist(), strict=True))
    known = spark.sparkContext.broadcast((held, total, min(held.values(), default=1)))
    id_kind = words.schema[id_column].dataType.simpleString()
    found = words.mapInArrow(_candidates(known, n), f"`{id_column}` {id_kind}, term string, tf long, known long")
    if len(held) == frequent:  # other words are looked up
        found = found.join(frequency, "term", "left").withColumn("known", F.coalesce("known", "df"))
    score = F.round(F.col("tf") * F.log((F.lit(total) + F.lit(1.0)) / (F.col("known") + 1.0)), 6)
    order = Window.partitionBy(id_column).orderBy(F.desc("score"), "term")
    return (
        found.select(id_column, "term", score.alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )
