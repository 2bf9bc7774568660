"""op1: ten nearest vectors for every hundredth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .ann import nearest
from .common import table
from .registry import query


@query("op1_projected_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
