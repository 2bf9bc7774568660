"""Mixing sources to target weights: repetition rates per source, copies per document.

Tokens are summed per source, every source gets a target, and a document is taken
floor(rate) times plus once more with the probability of the fraction, decided by a hash
of its id: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, small, words_of

# A source is repeated at most this often; what is beyond goes to the others by weight.
MAX_REPEATS = 3
# Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of ``sized(source, size)``: source, weight, source_size, target.

    All targets sum to the total size. Sources are filled in the order in which they reach
    their cap: a source is capped when its share of what is left is above ``repeats`` times
    its size, and the rest divide the remainder by weight. The table has a row per source,
    whatever the number of documents. A null source is a source, last in order; a source
    without words has target 0; an empty table gives no rows.
    """
    per_source = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = per_source.withColumn(
        "weight",
        F.element_at(cycle, ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")),
    ).withColumn("cap", F.col("source_size") * repeats)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    left = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double"))
        .withColumn("weights", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).cast("double"))
        .withColumn("full", F.col("cap").cast("double") * F.col("weights") < (F.col("total") - F.col("before")) * F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)).cast("double"))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything).cast("double"))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("total") - F.col("capped")) * F.col("weight") / F.col("open")
    )
    return left.select("source", F.col("weight").cast("long").alias("weight"), "source_size", target.alias("target"))


def chance(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = 10,
) -> DataFrame:
    """``row`` (the document, all its columns), size, source_size, target and copies.

    A null text has size 0; a document without an id draws like every other without one;
    repeated rows draw alike. Documents of a source without words are never taken.
    """
    sized = documents.select(
        F.struct("*").alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    )
    targets = materialise(source_targets(sized.select("source", "size"), weights, repeats), "mix-targets")
    joined = (
        sized.alias("d")
        .join(small(targets).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("row", "size", "source_size", "target", (F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).alias("rate"))
    )
    extra = (chance(F.col(f"row.{doc_id}"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select("row", "size", "source_size", "target", F.coalesce(F.floor("rate") + extra, F.lit(0)).alias("copies"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns only."""
    taken = with_copies(documents, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
