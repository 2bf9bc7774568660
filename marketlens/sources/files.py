"""JSON drops in, cleaned tables and reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

CRAWL_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("source_name", "url", "porter_force", "keywords", "raw_content")
    ]
    + [T.StructField("timestamp", T.TimestampType())]
)


def is_json_document(c: Column | str) -> Column:
    """Whether a text is one JSON object or array, with nothing after it."""
    raw = F.col(c) if isinstance(c, str) else c
    wrapped = F.concat(F.lit("["), raw, F.lit("]"))
    return raw.rlike(r"^\s*[\[{]") & F.coalesce(F.json_array_length(wrapped) == 1, F.lit(False))


def parsed(files: DataFrame, schema: T.StructType) -> DataFrame:
    """File texts ``(source_file, value)`` read once: ``(source_file, n_chars, records)``.

    ``records`` is NULL where a file holds no JSON records. The text itself is left behind.
    """
    found = F.when(is_json_document("value"), F.from_json("value", T.ArrayType(schema)))
    return files.select("source_file", F.length("value").alias("n_chars"), found.alias("records"))


def readable(read: DataFrame) -> DataFrame:
    """Rows of ``parsed`` files: array elements, or the one object, in order."""
    return (
        read.select("source_file", F.posexplode("records").alias("ordinal", "_r"))
        .filter(F.col("_r").isNotNull())
        .select("source_file", F.col("ordinal").cast("long").alias("ordinal"), "_r.*")
    )


def unreadable(read: DataFrame) -> DataFrame:
    """``parsed`` files that hold no JSON records, to report; the others go on without them."""
    return read.filter(F.col("records").isNull()).select("source_file", "n_chars")


def records(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of file texts ``(source_file, value)``."""
    return readable(parsed(files, schema))


def rejects(files: DataFrame, schema: T.StructType) -> DataFrame:
    """File texts that hold no JSON records."""
    return unreadable(parsed(files, schema))


def whole_files(
    spark: SparkSession, path: str, pattern: str = "*.json", name: Column | None = None
) -> DataFrame:
    """Every matching file below a folder as one row; files are spread over the tasks.

    A file is called by its own name unless ``name``, a function of its
    ``_metadata``, says otherwise.
    """
    return (
        spark.read.option("wholetext", True)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .text(path)
        .select((F.col("_metadata.file_name") if name is None else name).alias("source_file"), "value")
    )


def read_raw_drop(
    spark: SparkSession, path: str, schema: T.StructType, **naming
) -> tuple[DataFrame, DataFrame]:
    """Records of a drop folder, and the files that could not be read."""
    files = whole_files(spark, path, **naming)
    return records(files, schema), rejects(files, schema)


def read_json_documents(
    spark: SparkSession, path: str, content_key: str = "raw_content", **naming
) -> DataFrame:
    """One document per element of the JSON arrays under ``path``."""
    schema = T.StructType([T.StructField(content_key, T.StringType())])
    rows = records(whole_files(spark, path, **naming), schema)
    return rows.select("source_file", "ordinal", F.col(content_key).alias("text"))


def write_partitioned(
    df: DataFrame, path: str, column: str, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Write one folder per value of ``column``.

    The rebalance step gives a large value several writers and lets small ones
    share, by the sizes seen at run time. Overwriting replaces only the folders
    that are written.
    """
    (
        df.hint("rebalance", column)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .format(fmt)
        .save(path)
    )


def write_clean(leads: DataFrame, path: str, fmt: str = "json") -> None:
    """Cleaned leads, in one folder per source file."""
    write_partitioned(leads, path, "source_file", fmt)


def write_crawl(entries: DataFrame, path: str, fmt: str = "json") -> None:
    """Crawl entries, in one folder per force; a new crawl replaces the force's last one."""
    write_partitioned(entries, path, "porter_force", fmt)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines of force and text."""
    reports.select("force", "report_text").write.mode("overwrite").json(path)
