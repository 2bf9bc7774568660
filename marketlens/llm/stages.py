"""Stage functions of the corpus pipeline: (spark, docs, sf_dir) to the next documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .jaccard import one_per_group
from .mixing import mix
from .outliers import judge
from .packing import pack
from .secrets import ledger_path, redacted, update_ledger, with_findings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor lie far out in their language and source.

    Null and empty texts fail the base rules; repeated rows stay or go together; texts of any length
    are counted whole. An empty table gives an empty one. Further columns go along.
    """
    return judge(docs).where("kept").select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five-word shingles, similarity 0.8).

    Whole texts count, however long. Null and empty texts are like nothing and stay; of rows equal in
    id and text one stays. An empty table gives an empty one. Further columns go along.
    """
    return one_per_group(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret found replaced by its kind; lengths follow the text.

    Overlapping spans are replaced as one. Null texts stay null, empty ones empty, and every row,
    repeated ones too, goes on once. A session may name a ledger that outlives the run (``secrets``).
    """
    ledger = update_ledger(docs, ledger_path(spark))
    found = with_findings(docs, ledger)
    clean = found.select("row", redacted(F.col("row.text"), F.col("spans")).alias("text"))
    columns = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return clean.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources.

    Null and empty texts have no size and are copied at their source's rate like any other; a source
    without words is not taken. Rows with one id share its draw. An empty table gives an empty one. Further columns go along.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, neighbours together: ids and places, not the columns of documents.

    Every copy of every document is packed whole; null and empty texts have the end id only.
    """
    return pack(docs)
