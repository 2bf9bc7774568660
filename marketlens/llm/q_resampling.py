"""op11: documents drawn by their likeness to the benchmark's words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .registry import query
from .resampling import draw, weigh
from .sql_text import CRC_TABLE, alnum_words, crc32

RESAMPLING_SQL = f"""
with {CRC_TABLE}, words as (
  select doc_id, {alnum_words('text')} as w from documents
), wanted as (
  select unnest({alnum_words('text')}) as w from benchmark
), features as (
  select doc_id, unnest(w) as w from words
), places as (
  select w, {crc32('w')} % 10000 as bucket from (select w from features union select w from wanted) cross join crc_table
), source as (
  select bucket, count(*) as s from features join places using (w) group by 1
), target as (
  select bucket, count(*) as t from wanted join places using (w) group by 1
), gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from features) + 10000)
    / ((coalesce(s, 0) + 1)::double * ((select count(*) from wanted) + 10000))))::bigint as gain
  from source full join target using (bucket)
), weights as (
  select doc_id, sum(gain)::bigint as weight from features join places using (w) join gains using (bucket) group by 1
), scored as (
  select doc_id, len(w) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from words left join weights using (doc_id)
), ranked as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n
  from scored
)
select doc_id, n_features::bigint as n_features, weight, score,
  case when n_features >= 20 and place <= 10 * n // 100 then place end as rank
from ranked
"""


@query("op11_importance_resampling", RESAMPLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return draw(weighed, percent=10, least_words=20, seed=2024).select("doc_id", "n_features", "weight", "score", "rank")
