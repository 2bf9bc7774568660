"""op3: words of every document that no earlier document's 50-word window covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .registry import query
from .substrings import drop_repeats


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")
