"""Lead files cleaned as they arrive."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.leads import LEAD_SCHEMA, clean_leads, dedupe_leads
from ..sources.files import parsed, readable, unreadable


def stream_raw_drop(
    spark: SparkSession,
    drop_path: str,
    clean_path: str,
    reject_path: str,
    checkpoint: str,
    *,
    max_files: int = 10_000,
    pattern: str = "*.json",
    name: Column | None = None,
) -> StreamingQuery:
    """Clean each newly arrived file once and stop when the drop is drained.

    A file lies within one micro-batch and duplicates are sought within a file,
    so no state is kept. A batch is read and parsed once; what was parsed is kept on
    the executors until both outputs are written, and read again where one is lost. A batch writes to its
    own folders, so a batch that is run again after a failure replaces both outputs.
    """
    files = (
        spark.readStream.option("wholetext", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .text(drop_path)
        .select((F.col("_metadata.file_name") if name is None else name).alias("source_file"), "value")
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        read = parsed(batch, LEAD_SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            leads = dedupe_leads(clean_leads(readable(read)))
            leads.write.mode("overwrite").parquet(f"{clean_path}/batch={batch_id}")
            unreadable(read).write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
        finally:
            read.unpersist()

    return (
        files.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
