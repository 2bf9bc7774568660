"""The corpus pipeline: stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import stages
from marketlens.llm.common import materialise, table

STAGES = [
    ("quality rules", stages.quality_rules),
    ("n-gram Jaccard join", stages.jaccard_join),
    ("secret scans", stages.secret_scans),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

# Robust covariance estimates and retrieval packing are outside SQL; tests check each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
