"""op5: components of documents that share most of their 4-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .jaccard import near_duplicates
from .registry import query

JACCARD_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g
  from worded
), sizes as (
  select doc_id, count(*) as n from grams group by 1
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as both_
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * both_ >= 85 * (x.n + y.n - both_)
), edges as (
  select a, b from links union select b, a from links
), reach as (
  select a as doc_id, b as other from edges
  union select r.doc_id, e.b from reach r join edges e on e.a = r.other
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.least_, d.doc_id)) as component_id
from documents d left join sizes using (doc_id)
left join (select doc_id, min(other) as least_ from reach group by 1) m using (doc_id)
"""


@query("op5_jaccard_join", JACCARD_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)
