"""Source, sink and streaming queries.

Each writes a table derived from the given ones to the cluster's shared folder,
reads it back through the source under test and returns what it read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import crawl as crawl_ops, leads as lead_ops
from ..sources import files, vector_store
from ..sources.scratch import scratch_path
from ..sources.tables import derived, table
from ..streaming.raw_drop import stream_raw_drop as start_stream
from . import crawl, leads
from . import sql_text as q
from .registry import query
from .retrieval import chunks_sql

ROWS_PER_FILE = 1000

# Spark's text writer picks file names; the folder carries the drop's own.
DROPPED = {"pattern": "*.txt"}


def dropped_name() -> Column:
    return F.regexp_extract("_metadata.file_path", "/drop=([^/]+)/", 1)


def write_drop(rows: DataFrame, path: str, name: Column, order: str, record: Column) -> None:
    """JSON array files of at most ``ROWS_PER_FILE`` records each; a lone record is an object."""
    part = F.floor(F.col(order) / ROWS_PER_FILE)
    arrays = (
        rows.select(
            F.concat_ws("-", name, part.cast("string")).alias("drop"),
            F.struct(F.col(order).alias("_o"), record.alias("_r")).alias("_e"),
        )
        .groupBy("drop")
        .agg(F.sort_array(F.collect_list("_e")).alias("_e"))
        .withColumn("_e", F.transform("_e", lambda e: e["_r"]))
    )
    value = F.when(F.size("_e") == 1, F.to_json(F.col("_e")[0])).otherwise(F.to_json("_e"))
    arrays.select("drop", value.alias("value")).write.mode("append").partitionBy("drop").text(path)


def drop_leads(spark: SparkSession, sf_dir: str) -> str:
    """A drop folder of raw leads, with one broken file per segment beside the good ones."""
    path = scratch_path(spark, "raw-leads")
    raw = leads.raw_leads(spark, sf_dir)
    write_drop(raw, path, F.col("source_file"), "ordinal", F.struct(*lead_ops.LEAD_SCHEMA.names))
    broken = raw.groupBy("source_file").agg(F.first("company").alias("c")).select(
        F.concat(F.lit("broken-"), F.col("source_file")).alias("drop"),
        F.lit('[{"full_name": "cut off').alias("value"),
    )
    broken.write.mode("append").partitionBy("drop").text(path)
    return path


def drop_crawl(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "crawl")
    pages = crawl_ops.extract_pages(derived(spark, sf_dir, "fetches"))
    usable = crawl_ops.usable(pages)
    record = F.struct("url", "porter_force", "keywords", "raw_content")
    write_drop(usable, path, F.col("porter_force"), "page_id", record)
    return path


_DROPPED_LEADS = """
dropped as (
  select * exclude (source_file, ordinal, part),
    concat(source_file, '-', cast(part as varchar)) as source_file,
    row_number() over (partition by source_file, part order by ordinal) - 1 as ordinal
  from (select *, ordinal // 1000 as part from raw_leads))
"""
_DROPPED_CLEAN = f"""{_DROPPED_LEADS},
{leads.DEDUPED_SQL.replace('from raw_leads', 'from dropped')}
"""


@query(
    "src_raw_drop",
    f"""with {_DROPPED_LEADS}
    select source_file, ordinal, full_name, email, phone, company, job_title, street, city,
      postal_code, country, linkedin_url, website_url, industry, company_size, source
    from dropped""",
    uses=("raw_leads",),
)
def src_raw_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = files.read_raw_drop(
        spark, drop_leads(spark, sf_dir), lead_ops.LEAD_SCHEMA, name=dropped_name(), **DROPPED
    )
    return leads.flat_address(rows)


@query(
    "src_raw_rejects",
    """select 'broken-' || source_file as source_file, 23 as n_chars
    from raw_leads group by source_file""",
    uses=("raw_leads",),
)
def src_raw_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = files.read_raw_drop(
        spark, drop_leads(spark, sf_dir), lead_ops.LEAD_SCHEMA, name=dropped_name(), **DROPPED
    )
    return bad


_CRAWL_DOCS_SQL = f"""{crawl.EXTRACTED_SQL},
documents_read as (
  select concat(porter_force, '-', cast(page_id // 1000 as varchar)) as source_file,
    row_number() over (partition by porter_force, page_id // 1000 order by page_id) - 1 as ordinal,
    raw_content as text
  from extracted where raw_content not like 'Failed to extract content: %')
"""


@query(
    "src_json_array",
    f"with {_CRAWL_DOCS_SQL} select * from documents_read",
    uses=("fetches",),
)
def src_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files.read_json_documents(
        spark, drop_crawl(spark, sf_dir), name=dropped_name(), **DROPPED
    )
    return docs.withColumn("source_file", F.url_decode("source_file"))


@query("sink_clean", f"with {_DROPPED_CLEAN} select * from deduped", uses=("raw_leads",))
def sink_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = files.read_raw_drop(
        spark, drop_leads(spark, sf_dir), lead_ops.LEAD_SCHEMA, name=dropped_name(), **DROPPED
    )
    cleaned = lead_ops.dedupe_leads(lead_ops.clean_leads(rows))
    path = scratch_path(spark, "clean")
    files.write_clean(cleaned, path)
    back = spark.read.schema(cleaned.schema).json(path)
    return leads.flat_address(back).drop("last_updated")


@query("sink_crawl", f"with {crawl.ENTRIES_SQL} select * from entries", uses=("fetches",))
def sink_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crawls of everything; the second replaces the first force by force."""
    entries = crawl_ops.crawl_entries(crawl_ops.extract_pages(derived(spark, sf_dir, "fetches")))
    path = scratch_path(spark, "crawl-table")
    files.write_crawl(entries.withColumn("raw_content", F.lit("stale")), path)
    files.write_crawl(entries, path)
    return spark.read.schema(entries.schema).json(path).drop("timestamp")


@query(
    "sink_report",
    "select force, text as report_text from reports",
    uses=("reports",),
)
def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = derived(spark, sf_dir, "reports").select("force", F.col("text").alias("report_text"))
    path = scratch_path(spark, "reports")
    files.write_reports(reports, path)
    return spark.read.schema(reports.schema).json(path)


@query(
    "vector_table_append",
    f"""with {chunks_sql('documents')}
    select 'documents' as index_name, doc_id, chunk_ix, sha256(chunk_text) as chunk_hash from chunks""",
)
def vector_table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append every chunk, then again in both ways: nothing is stored twice."""
    from ..operators.chunks import chunk_windows
    from ..operators.retrieval import embed_hash

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Embedded once: each append would embed all texts again.
    chunks, once = embed_hash(chunk_windows(docs, "text"), "chunk_text"), scratch_path(spark, "embedded")
    chunks.write.parquet(once)
    chunks = spark.read.schema(chunks.schema).parquet(once)
    path = scratch_path(spark, "vectors")
    vector_store.append(chunks, path, "documents")
    vector_store.append(chunks, path, "documents")
    vector_store.append(chunks, path, "documents", skip_known=True)
    rows = vector_store.load(spark, path, "documents")
    return rows.select("index_name", "doc_id", "chunk_ix", "chunk_hash")


@query(
    "vector_table_replace",
    f"""with {chunks_sql('documents')}
    select doc_id, chunk_ix, chunk_text, case when doc_id % 3 = 0 then 'new' else 'old' end as edition from chunks""",
)
def vector_table_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored, then every third anew: its new chunks stand in place of the old."""
    from ..operators.chunks import chunk_windows

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = chunk_windows(docs, "text")
    path = scratch_path(spark, "replaced-vectors")
    vector_store.append(chunks.withColumn("edition", F.lit("old")), path, "documents")
    third = chunks.filter("doc_id % 3 = 0").withColumn("edition", F.lit("new"))
    vector_store.append(third, path, "documents", replace=True)
    return vector_store.load(spark, path, "documents").select("doc_id", "chunk_ix", "chunk_text", "edition")


@query(
    "vector_table_load",
    """select 'label-3' as index_name, vec_id, round(list_sum(embedding::double[]), 5) as total
    from embeddings where label = 3""",
)
def vector_table_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors stored as one index per label; one index opened by name."""
    items = table(spark, sf_dir, "embeddings").withColumn(
        "index_name", F.concat(F.lit("label-"), F.col("label").cast("string"))
    )
    path = scratch_path(spark, "label-vectors")
    vector_store.store(items, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return vector_store.load(spark, path, "label-3").select(
        "index_name", "vec_id", F.round(total, 5).alias("total")
    )


@query(
    "ingest_document",
    f"""with {_CRAWL_DOCS_SQL},
    {chunks_sql('documents_read', "source_file, ordinal")}
    select source_file, ordinal, chunk_ix, chunk_text, 1.0::double as unit_norm from chunks""",
    uses=("fetches",),
)
def ingest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import norm

    docs = files.read_json_documents(
        spark, drop_crawl(spark, sf_dir), name=dropped_name(), **DROPPED
    )
    named = docs.select(F.to_json(F.array(F.url_decode("source_file"), F.col("ordinal").cast("string"))).alias("doc_key"), "text")
    path = scratch_path(spark, "ingested")
    vector_store.ingest(named, "doc_key", "text", path, "crawl")
    key = F.from_json("doc_key", "array<string>")
    return vector_store.load(spark, path, "crawl").select(
        key[0].alias("source_file"),
        key[1].cast("long").alias("ordinal"),
        "chunk_ix",
        "chunk_text",
        F.round(norm("embedding"), 4).alias("unit_norm"),
    )


@query("stream_raw_drop", f"with {_DROPPED_CLEAN} select * from deduped", uses=("raw_leads",))
def stream_raw_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "stream")
    stream = start_stream(
        spark,
        drop_leads(spark, sf_dir),
        f"{out}/clean",
        f"{out}/rejects",
        f"{out}/checkpoint",
        name=dropped_name(),
        **DROPPED,
    )
    stream.awaitTermination()
    rows = spark.read.parquet(f"{out}/clean")
    return leads.flat_address(rows).drop("batch", "last_updated")
