"""op13: words of the corpus and the forms they are slips of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .registry import query
from .spelling import spelling_variants, vocabulary
from .sql_text import CRC_TABLE, crc32, lowered

SPELLING_SQL = f"""
with recursive {CRC_TABLE}, runs as (
  select doc_id, unnest(regexp_extract_all({lowered('text')}, '[a-zÀ-ÿ]+')) as r from documents
), counted as (
  select doc_id, r, count(*) as k from runs where length(r) >= 6 group by all
), hashed as (
  select r, k, {crc32("(doc_id || ':' || r)")} as h from counted cross join crc_table
), results as (
  select case when h % 199 = 0 then substring(r, 1, (h % length(r))::bigint) || substring(r, (h % length(r))::bigint + 2) else r end as word, k from hashed
), words as (
  select word, sum(k)::bigint as n from results where length(word) >= 6 group by 1 having sum(k) >= 5
), cut as (
  select word, n, unnest(range(1, length(word) + 1)) as i, unnest(list_transform(range(1, length(word) + 1), lambda p: substring(word, 1, p - 1) || substring(word, p + 1))) as rest
  from words
), longer as (
  select distinct c.word as a, w.word as b, c.n as na, w.n as nb from cut c join words w on c.rest = w.word
), near as (
  select a as word, b as near, nb as n_near from longer union all select b, a, na from longer
  union all select x.word, y.word, y.n from cut x join cut y on x.rest = y.rest and x.i = y.i and x.word <> y.word
), best as (
  select word, count(*) as n_near, arg_min(near, (-n_near, near)) as form, max(n_near) as form_n from near group by 1
), formed as (
  select word, n, coalesce(b.n_near, 0)::bigint as n_near, case when b.form_n >= 5 * n then b.form end as form, case when b.form_n >= 5 * n then b.form_n end as form_n
  from words left join best b using (word)
), chain as (
  select word, word as root from formed
  union all select c.word, f.form from chain c join formed f on f.word = c.root where f.form is not null
), ends as (
  select c.word, c.root from chain c join formed f on f.word = c.root where f.form is null
)
select word, form, root, n, n_near, form_n from formed join ends using (word)
"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(vocabulary(documents, least=6, min_count=5, slip=199))
