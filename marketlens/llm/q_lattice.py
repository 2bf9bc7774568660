"""op4: log probability of every document under a subword lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .lattice import score_texts
from .registry import query


@query("op4_subword_lattice")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True))
    return score_texts(documents, training)
