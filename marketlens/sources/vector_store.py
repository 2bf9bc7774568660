"""Named vector indexes in one folder: Parquet data, and a manifest that says which appends count.

An append writes its rows to a folder of its own and is committed by one manifest row. Readers take
the folders the manifest names, so an append that failed half-way is never seen.

    chunks/append=<number-id>/index_name=<name>/   rows
    replaced/append=<number-id>/                   documents whose earlier rows no longer count
    appends/                                       the manifest, one row per append and index
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.chunks import chunk_paragraphs
from ..operators.retrieval import embed_hash
from .files import write_partitioned
from .scratch import discard

MANIFEST = T.StructType(
    [T.StructField(n, T.LongType() if n in ("number", "rows") else T.StringType())
     for n in ("index_name", "append", "number", "rows", "digest", "schema", "replaces")]
)


class MissingIndex(LookupError):
    """The named index does not exist."""


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Committed appends, one row per append and index; empty where nothing was stored."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/appends")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def store(rows: DataFrame, path: str, *, replaces: str | None = None, again: bool = False) -> None:
    """Add rows to the indexes that their ``index_name`` names, all of them or none.

    Rows that an earlier append gave an index, all of them and no others, are not stored again
    unless ``again``, so a repeated append leaves one copy. They are known by count and
    128 bits of digest over all columns; a column of maps has to be rewritten first. ``replaces``
    names a column of document ids: what earlier appends hold of those documents no longer counts;
    then only the last append is the one that may be repeated.
    One writer at a time: of two at once, neither replaces the other's documents.
    """
    spark = rows.sparkSession
    held = manifest(spark, path)
    number = held.agg(F.coalesce(F.max("number"), F.lit(0)) + 1).first()[0]
    name = f"{number:09d}-{uuid.uuid4().hex}"
    staged = f"{path}/chunks/append={name}"
    write_partitioned(rows, staged, "index_name", mode="append")

    columns = [f for f in rows.schema if f.name != "index_name"]
    schema = T.StructType([*columns, T.StructField("index_name", T.StringType())])
    written = spark.read.schema(schema).parquet(staged)
    names = sorted(f.name for f in columns)
    sums = [F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    kind = F.lit(",".join(names))
    new = written.groupBy("index_name").agg(
        F.count("*").alias("rows"), F.concat_ws("/", F.sha2(kind, 256), *sums).alias("digest")
    )
    if not again:
        known = held.select("index_name", "rows", "digest")
        if replaces is not None:  # earlier content may come back, so only the last append counts as the same
            last = held.groupBy("index_name").agg(F.max_by(F.struct("rows", "digest"), "number").alias("_l"))
            known = last.select("index_name", "_l.*")
        new = new.join(known, known.columns, "left_anti")
    new = new.select(
        "index_name",
        F.lit(name).alias("append"),
        F.lit(number).cast("long").alias("number"),
        "rows",
        "digest",
        F.lit(T.StructType(columns).json()).alias("schema"),
        F.lit(replaces).cast("string").alias("replaces"),
    )
    if replaces is not None:
        ids = written.select("index_name", F.col(replaces).cast("string").alias("_id")).distinct()
        ids.write.parquet(f"{path}/replaced/append={name}")
    # One file, so the rename that ends the write commits every index at once.
    new.coalesce(1).write.mode("append").parquet(f"{path}/appends")
    if manifest(spark, path).filter(F.col("append") == name).isEmpty():
        discard(spark, staged)
        discard(spark, f"{path}/replaced/append={name}")


def append(
    chunks: DataFrame,
    path: str,
    index_name: str,
    *,
    id_column: str = "doc_id",
    skip_known: bool = False,
    replace: bool = False,
    again: bool = False,
) -> None:
    """Add chunk vectors to a named index, which is created if new.

    Appending the same chunks again changes nothing unless ``again``. ``skip_known`` also drops single
    chunks whose text the index already holds; then only digests are compared.
    ``replace`` puts the chunks in place of all that the index holds of their documents.
    """
    rows = chunks.withColumn("index_name", F.lit(index_name)).withColumn(
        "chunk_hash", F.sha2("chunk_text", 256)
    )
    if skip_known:
        try:
            known = load(chunks.sparkSession, path, index_name).select("chunk_hash")
            rows = rows.join(known, "chunk_hash", "left_anti")
        except MissingIndex:
            pass
        # The first of equal chunks, cut to one per task before the exchange.
        first = Window.partitionBy("chunk_hash").orderBy(id_column, "chunk_ix")
        rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    store(rows, path, replaces=id_column if replace else None, again=again)


def load(spark: SparkSession, path: str, index_name: str) -> DataFrame:
    """Vectors of one index; only its folders in the committed appends are read.

    The schema comes from the manifest's last append, so no data file is opened for it. The rows are
    those of the appends committed now; later ones do not change them.
    """
    held = manifest(spark, path).filter(F.col("index_name") == index_name).orderBy("append").collect()
    if not held:
        raise MissingIndex(index_name)
    # Names are text: inferred types would make one index of `1` and `01`.
    schema = T.StructType.fromJson(json.loads(held[-1]["schema"])).add("append", "string").add("index_name", "string")

    def read(folder: str, appends: list[str], columns: T.StructType) -> DataFrame:
        base = f"{path}/{folder}"
        rows = spark.read.schema(columns).option("basePath", base)
        return rows.parquet(*[f"{base}/append={a}" for a in appends]).filter(F.col("index_name") == index_name)

    rows = read("chunks", [r["append"] for r in held], schema)
    replacing = [r["append"] for r in held[1:] if r["replaces"] is not None]
    if replacing:
        id_column = next(r["replaces"] for r in reversed(held) if r["replaces"] is not None)
        ids = T.StructType().add("index_name", "string").add("_id", "string").add("append", "string")
        last = read("replaced", replacing, ids).groupBy("_id").agg(F.max("append").alias("_last"))
        old = F.col(id_column).cast("string").eqNullSafe(F.col("_id")) & (F.col("append") < F.col("_last"))
        rows = rows.join(last, old, "left_anti")
    return rows.drop("append")


def embed_chunks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Chunks of each document with their vectors and a number to search by.

    A chunk is its document and place (``chunk_ix``); the store goes by these. ``chunk_id`` is a hash of both:
    two chunks that share one, to be expected from billions of chunks on, are both kept and both found.
    """
    chunks = embed_hash(chunk_paragraphs(docs, id_column, text_column), "chunk_text")
    return chunks.withColumn("chunk_id", F.xxhash64(id_column, "chunk_ix"))


def ingest(
    docs: DataFrame, id_column: str, text_column: str, path: str, index_name: str, *, replace: bool = False
) -> None:
    """Chunk, embed and append documents; ``replace`` drops what the index held of them."""
    append(embed_chunks(docs, id_column, text_column), path, index_name, id_column=id_column, replace=replace)
