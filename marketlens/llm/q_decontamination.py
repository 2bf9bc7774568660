"""op12: words of documents inside passages of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .decontamination import find_leaks, hit_words
from .registry import query
from .sql_text import alnum_words

LEAKS_SQL = f"""
with words as (
  select doc_id, {alnum_words('text')} as w from documents
), items as (
  select item_id, {alnum_words('text')} as w from benchmark
), windows as (
  select distinct item_id, unnest(case when len(w) = 0 then [] when len(w) < 10 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) end) as g,
    least(len(w), 10) as k
  from items
), sizes as (
  select distinct k from windows
), grams as (
  select doc_id, k, unnest(range(1, len(w) - k + 2)) as p, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as g
  from words join sizes on len(w) >= k
), hits as (
  select doc_id, p, item_id, grams.k from grams join windows on windows.g = grams.g and windows.k = grams.k
), covered as (
  select doc_id, count(distinct q) as n_hit from (select distinct doc_id, unnest(range(p, p + k)) as q from hits) group by 1
), met as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, item_id::varchar as i from hits) group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (doc_id) left join met using (doc_id)
"""


@query("op12_suffix_decontamination", LEAKS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(documents, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "row.doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
