"""op2: quality of every document, learnt from the labelled rows that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .quality import THRESHOLD, score, train
from .registry import query


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@query("op2_quality_ftrl")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    weights = train(documents, labels)
    ids = documents.select("doc_id", "text")
    scored = score(ids, weights, keep=["doc_id"])
    return scored.select(
        "row.doc_id", held_out("row.doc_id").alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
