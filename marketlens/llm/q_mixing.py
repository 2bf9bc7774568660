"""op10: mix all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .mixing import with_copies
from .registry import query

MIX_SQL = r"""
with sized as (
  select doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents
), per_source as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select *, 3 * source_size as cap, sum(source_size) over ()::double as total,
    (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from per_source
), filled as (
  select *,
    coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as before,
    sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following)::double as weights
  from ranked
), marked as (
  select *, cap::double * weights < (total - before) * weight as filled_up from filled
), targets as (
  select source, source_size,
    case when filled_up then cap::double
      else (total - coalesce(sum(cap) filter (filled_up) over (), 0)::double) * weight
        / sum(weight) filter (not filled_up) over ()::double end as target
  from marked
), rated as (
  select doc_id, size::bigint as size, source_size, target, target / nullif(source_size, 0) as rate,
    ('0x' || substr(md5('10:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0::double as u
  from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, size, source_size, target,
  coalesce(size * (floor(rate)::bigint + (u < rate - floor(rate))::bigint), 0)::bigint as taken
from rated
"""


@query("op10_mix_sources", MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = with_copies(documents)
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )
