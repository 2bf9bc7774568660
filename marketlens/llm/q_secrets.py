"""op7: secrets in every document, through a ledger of distinct texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .registry import query
from .secrets import RULES, ledger_path, spans_text, update_ledger, with_findings


def _matches_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of one rule in order, each with the text between it and the one before."""
    quoted = pattern.replace("'", "''")
    return rf"""
  select rid, '{kind}' as kind, {rank} as rank, {least} as least,
    unnest(range(len(whole))) as k, unnest(whole) as match, unnest(counted) as counted, unnest(gaps[:len(whole)]) as gap
  from (select rid, regexp_extract_all(text, '{quoted}') as whole, regexp_extract_all(text, '{quoted}', {group}) as counted,
    string_split_regex(text, '{quoted}') as gaps from rows_)"""


def secrets_sql() -> str:
    rules = [r for group in RULES.values() for r in group]
    matches = "\n  union all".join(_matches_sql(i, *r) for i, r in enumerate(rules))
    count = lambda kind: f"count(*) filter (kind = '{kind}') as n_{kind}"
    joined = "coalesce(string_agg(span, ',' order by start, rank){}, '')"
    base = joined.format(" filter (kind in ('assign', 'access', 'hex'))")
    return f"""
with rows_ as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
matches as ({matches}),
placed as (
  select *, sum(length(gap) + length(match)) over (partition by rid, rank order by k)::bigint as stop from matches),
spans as (
  select rid, kind, rank, stop - length(match) as start, kind || ':' || (stop - length(match)) || ':' || stop as span
  from placed where length(counted) >= least)
select doc_id, {count('assign')}, {count('access')}, {count('hex')}, sha256({base}) as base_sha256, {joined.format('')} as spans
from rows_ left join spans using (rid) group by rid, doc_id
"""


@query("op7_secret_ledger", secrets_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = update_ledger(documents, ledger_path(spark))
    found = with_findings(documents, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )
