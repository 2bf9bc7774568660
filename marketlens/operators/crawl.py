"""Crawled pages: text extraction, entries, routing, hits."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import html, text

# Names of an entry and of a broad search hit that have none.
DEFAULT_ENTRY_NAME = "Unknown"
DEFAULT_HIT_TITLE = "Tavily Result"


def extract_pages(fetches: DataFrame) -> DataFrame:
    """Visible text of each fetched page, cut to size; a failed fetch keeps its error as text.

    ``status`` comes from the error, so filtering on it does not extract the text twice.
    """
    failed = F.concat(F.lit(text.FAILURE_PREFIX), F.col("error"))
    content = F.when(F.col("error").isNotNull(), failed).otherwise(
        text.truncate(html.html_to_text("html"))
    )
    return (
        fetches.withColumn("raw_content", content)
        .withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("ok"))
        .drop("html", "error")
    )


def crawl_entries(pages: DataFrame, *, timestamp: bool = True) -> DataFrame:
    entries = pages.select(
        F.coalesce("name", F.lit(DEFAULT_ENTRY_NAME)).alias("source_name"),
        "url",
        "porter_force",
        "keywords",
        "raw_content",
        "status",
    )
    return entries.withColumn("timestamp", F.current_timestamp()) if timestamp else entries


def usable(entries: DataFrame) -> DataFrame:
    """Entries whose fetch worked; the failure text never reaches chunking."""
    return entries.filter(F.col("status") == "ok")


class _VisibleText(HTMLParser):
    """Text nodes outside script, style and noscript."""

    hidden_tags = frozenset(("script", "style", "noscript"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.open_hidden: list[str] = []
        self.joined = False

    def handle_starttag(self, tag, attrs):
        self.joined = False
        if tag in self.hidden_tags:
            self.open_hidden.append(tag)

    def handle_endtag(self, tag):
        self.joined = False
        if tag in self.open_hidden:
            del self.open_hidden[self.open_hidden.index(tag):]

    def handle_startendtag(self, tag, attrs):
        self.joined = False

    def handle_comment(self, data):
        self.joined = False

    def handle_data(self, data):
        if self.open_hidden:
            return
        if self.joined:
            self.nodes[-1] += data
        else:
            self.nodes.append(data)
        self.joined = True


def visible_text(markup: str | None) -> str | None:
    if markup is None:
        return None
    parser = _VisibleText()
    parser.feed(markup)
    parser.close()
    return " ".join(n for n in map(str.strip, parser.nodes) if n)


def extract_pages_strict(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """As ``html_to_text``, with a real HTML tokenizer in Arrow batches."""
    id_type = pages.schema[id_column].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(m) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"]
            )

    return pages.select(id_column, html_column).mapInArrow(
        parse, f"{id_column} {id_type}, text string"
    )


def crawl_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("porter_force").agg(F.count("*").alias("entries"))


def route_sources(requests: DataFrame, forces: DataFrame, routes: DataFrame) -> DataFrame:
    """Sources to ask for each request; a force nobody knows keeps one row without a source."""
    routed = routes.join(
        forces, F.lower("routing_force") == F.col("alias")
    ).select("force", "source", "source_rank")
    named = requests.join(
        forces, F.lower(F.trim("porter_force")) == F.col("alias"), "left"
    ).drop("alias")
    return named.join(routed, "force", "left")


def top_hits_per_source(hits: DataFrame, n: int = 3) -> DataFrame:
    """At most ``n`` hits per routed source, in result order."""
    order = Window.partitionBy("porter_force", "source").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("hit_rank", F.row_number().over(order)).filter(F.col("hit_rank") <= n)


def union_hits(broad: DataFrame, routed: DataFrame) -> DataFrame:
    """Broad hits followed by routed ones; duplicates stay."""
    return broad.unionByName(routed)
