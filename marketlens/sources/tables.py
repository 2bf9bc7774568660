"""The given Parquet tables, and inputs that Spark derives from them row by row.

Each derived table is one SELECT in the dialect Spark and DuckDB share, so the
checking SQL starts from exactly the same rows.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

# Raw leads: one per customer, with the defects a lead feed shows.
RAW_LEADS = """
select c_custkey as ordinal, c_mktsegment as source_file,
  case c_custkey % 5
    when 0 then concat('  mary-jane   smith & co ', cast(c_custkey as string))
    when 1 then concat('josé o.k mcDONALD', cast(c_custkey as string))
    when 2 then 'cher' when 3 then ' ! ' else c_name end as full_name,
  case c_custkey % 7 when 0 then cast(null as string) when 1 then 'not-an-email'
    else concat(' User', cast(c_custkey % 400 as string), '@Example.COM ') end as email,
  case c_custkey % 6 when 0 then '(415) 555-2671' when 1 then '+44 20 7946 0958'
    when 2 then '12345' when 3 then '1-212-555-0100' when 4 then cast(null as string)
    else concat('650253', lpad(cast(c_custkey % 10000 as string), 4, '0')) end as phone,
  case c_custkey % 4 when 0 then 'Acme Tech, Inc' when 1 then 'Blue Startup'
    when 2 then 'Old Software (Startup) Co' else 'tech lower' end as company,
  case c_custkey % 4
    when 0 then concat('VP Sales, Acme Tech NATION_', cast(c_nationkey as string))
    when 1 then 'Head of Data at Blue Startup; AFRICA and EUROPE'
    when 2 then cast(null as string)
    else concat('Analyst   Acme Tech & Blue Startup # ', cast(c_custkey as string)) end as job_title,
  case c_custkey % 3 when 0 then cast(null as string)
    else concat(cast(c_custkey as string), ' Main St. #', cast(c_nationkey as string)) end as street,
  concat(' City  ', cast(c_nationkey as string), ' ') as city,
  lpad(cast(c_custkey % 100000 as string), 5, '0') as postal_code,
  concat('NATION_', cast(c_nationkey as string), '!') as country,
  concat('linkedin.com/in/u', cast(c_custkey as string)) as linkedin_url,
  case c_custkey % 5 when 0 then 'example.com/a' when 1 then 'https://x.example.org'
    when 2 then 'HTTPS://UP.example' when 3 then 'ftp://f.example' else '' end as website_url,
  cast(null as string) as industry,
  case when c_custkey % 2 = 0 then '1-10' else cast(null as string) end as company_size,
  case when c_custkey % 9 = 0 then cast(null as string) else 'feed' end as source
from {customer}
"""

# Page fetches: most carry HTML, some carry the error text of a failed fetch.
FETCHES = """
select page_id, url,
  case when page_id % 8 = 3 then cast(null as string)
    else concat('Page ', cast(page_id as string)) end as name,
  case page_id % 5 when 0 then 'Buyer Power' when 1 then 'Supplier Power'
    when 2 then 'New Entrants' when 3 then 'Substitute Products'
    else 'Industry Rivalry' end as porter_force,
  case when page_id % 9 = 4 then cast(null as string) else html end as html,
  case when page_id % 9 = 4
    then concat('timeout after 10 s for ', url) else cast(null as string) end as error,
  concat('payments, "open banking" , ', url) as keywords
from {pages}
"""

# Keyword expansions: comma lists of very different lengths, one per part.
KEYWORD_REQUESTS = """
select p_partkey as request_id, p_name as original_keywords,
  case p_partkey % 5 when 0 then 'Buyer Power' when 1 then 'Supplier Power'
    when 2 then 'New Entrants' when 3 then 'Substitute Products'
    else 'Industry Rivalry' end as porter_force,
  case when p_partkey % 37 = 0 then ' , ,'
    when p_partkey % 41 = 0 then repeat(concat(p_name, ' '), 60)
    else repeat(concat(p_name, ' ', p_type, ', "', p_brand, ' supplier" ,'), 1 + p_size % 20)
    end as keywords
from {part}
"""

# Business ideas and what an evaluator model answered about them.
RESPONSES = """
select p_partkey as idea_id, concat('A ', lower(p_type), ' marketplace for ', p_name) as idea,
  case
    when p_partkey % 17 = 0 then concat('  not json ', cast(p_partkey as string), ' ')
    when p_partkey % 23 = 0 then '[1, 2]'
    when p_partkey % 13 = 0 then
      concat('{{"market_viability": ', cast(p_size % 11 as string), ', "reason": "short"}}')
    when p_partkey % 19 = 0 then
      concat('{{"relevance_score": null, "market_viability": ', cast(p_size % 11 as string), '}}')
    else concat('{{"relevance_score": ', cast(p_partkey % 6 + 5 as string),
      ', "market_viability": ', cast(p_size % 5 + 5 as string),
      ', "competitive_edge": ', cast(p_partkey % 5 + 6 as string),
      ', "revenue_model": ', cast(p_partkey % 4 + 5 as string),
      ', "team_capability": ', cast(p_size % 4 + 6 as string),
      ', "verdict": "pass", "tags": ["é", {{"n": 1.5}}], "reason": "', p_name, '"}}') end as response
from {part}
"""

# Crawl summaries as a model returned them.
SUMMARIES = """
select page_id, url,
  case when page_id % 6 = 1 then cast(null as string)
    else concat('Page ', cast(page_id as string)) end as source_name,
  case page_id % 5 when 0 then 'Buyer Power' when 1 then 'Supplier Power'
    when 2 then 'New Entrants' when 3 then 'Substitute Products'
    else 'Industry Rivalry' end as porter_force,
  case when page_id % 4 = 0 then concat('Plain words about ', url)
    else concat('{{"source_name": "S', cast(page_id as string),
      '", "porter_force": "Buyer Power", "summary": "about ', url,
      '", "key_metrics": [1, "two"], "data_points": [{{"a": ', cast(page_id as string), '}}]}}')
    end as response
from {pages}
"""

# Analyst notes: one per order; figures, dates and cue phrases.
NOTES = """
select o_orderkey as doc_id, o_custkey as entity_id, o_orderdate as ts,
  concat('src', cast(o_custkey % 7 as string)) as source,
  case o_orderkey % 5 when 0 then 'rivalry' when 1 then 'buyer_power' when 2 then 'supplier_power'
    when 3 then 'substitutes' else 'new_entrants' end as force,
  o_totalprice as amount,
  concat('Customer ', cast(o_custkey as string), ' had a budget of $',
    cast(cast(o_orderkey % 900 + 100 as int) as string),
    case o_orderkey % 3 when 0 then 'K' when 1 then 'M' else '' end,
    ' and share ', cast(o_orderkey % 100 as string), '%; churn ',
    cast(o_orderkey % 10 as string), '.5% on ',
    substring(cast(o_orderdate as string), 1, 10), '. ',
    case o_orderkey % 12
      when 0 then 'Switching cost is high and migration is slow; the contract runs 24 months.'
      when 1 then 'Buyers are price sensitive and expect a discount.'
      when 2 then 'They asked for a demo, a trial and a pricing quote.'
      when 3 then 'Profit margin reached 18% while revenue grew 7.5%.'
      when 4 then 'A new license was issued after the regulation changed.'
      when 5 then 'Venture capital funding of $2,500K closed for a startup.'
      when 6 then 'The patent covers a proprietary platform, a unique technology.'
      when 7 then 'A blockchain substitute offers feature parity at a cheaper price.'
      when 8 then 'Adoption is growing and consumers prefer the mobile app; excellent service.'
      when 9 then 'The incumbent brand and economies of scale deter a bank from acquisition.'
      when 10 then 'Unit cost rose to $42.50 after an outage; poor support on a 12 month term.'
      else 'Acquisition spend was $3K for 12 new customers; the alternative is growing.' end) as text
from {orders}
"""

# Force reports: one per customer, some without a section, some with loose figures.
REPORTS = """
select c_custkey as report_id, c_custkey as entity_id,
  case c_custkey % 5 when 0 then 'rivalry' when 1 then 'buyer_power' when 2 then 'supplier_power'
    when 3 then 'substitutes' else 'new_entrants' end as force,
  concat('# Report on ', c_name, '. ',
    case when c_custkey % 4 = 0 then '' else 'Market Concentration Score: 4/10. Customer Concentration Score: 5/10. ' end,
    case when c_custkey % 6 = 0 then '' else 'Trend Analysis and Lead Scoring Model follow. Supplier Criticality Score: 3/10. ' end,
    'SUBSTITUTION THREAT SCORE 6, Entry Threat Score 2. ',
    case when c_custkey % 3 = 0 then 'Financial Metrics and Cost Structure Analysis. ' else '' end,
    case when c_custkey % 7 = 0 then '' else 'Disruption Analysis. Entrant Profiling. Financial Health Indicators. ' end,
    'Dashboard Metrics. Risk Assessment. Churn was ', cast(c_custkey % 10 as string), '.5%, balance $',
    cast(cast(c_custkey % 900 + 100 as int) as string), 'K and share ', cast(c_custkey % 100 as string), '%.'
  ) as text
from {customer}
"""

# Long notes: paragraphs parted by blank lines, some longer than one chunk.
PARAGRAPH_DOCS = """
select doc_id, source, case doc_id % 4
    when 0 then replace(text, '. ', concat('.', chr(10), chr(10)))
    when 1 then text
    when 2 then concat(substring(text, 1, 700), chr(10), chr(10), substring(text, 701, 1500),
      chr(10), chr(10), substring(text, 2201))
    else concat(chr(10), replace(text, '. ', concat('.', chr(10), chr(10), chr(10)))) end as text
from {documents}
"""

# Company names in two systems; the external one carries typing errors.
INTERNAL_COMPANIES = """
select c_custkey as company_id, c_acctbal as balance, c_mktsegment as segment,
  translate(substring(md5(concat('c', cast(c_custkey as string))), 1, 12), '0123456789', 'ghijklmnop')
    as company_name
from {customer}
"""
EXTERNAL_COMPANIES = """
select 1000000 + company_id as external_id, case company_id % 5
    when 0 then company_name
    when 1 then concat(substring(company_name, 1, 3), substring(company_name, 5))
    when 2 then concat(substring(company_name, 1, 5), 'z', substring(company_name, 6))
    when 3 then concat(substring(company_name, 1, 7), 'q', substring(company_name, 9))
    else reverse(company_name) end as company_name,
  case when company_id % 3 = 0 then cast(null as string) else 'external' end as segment
from {internal_companies}
"""

DERIVED: dict[str, str] = {
    "raw_leads": RAW_LEADS,
    "fetches": FETCHES,
    "keyword_requests": KEYWORD_REQUESTS,
    "responses": RESPONSES,
    "summaries": SUMMARIES,
    "notes": NOTES,
    "reports": REPORTS,
    "paragraph_docs": PARAGRAPH_DOCS,
    "internal_companies": INTERNAL_COMPANIES,
    "external_companies": EXTERNAL_COMPANIES,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _inputs(sql: str) -> list[str]:
    return sorted({f for _, f, _, _ in Formatter().parse(sql) if f})


def derived(spark: SparkSession, sf_dir: str, name: str, *, spread: bool = False) -> DataFrame:
    """A derived table; ``spread`` deals the rows of its inputs out evenly first.

    A table of short rows may be one file of one row group, which only one task can read.
    """
    sql = DERIVED[name]
    inputs = {
        i: derived(spark, sf_dir, i) if i in DERIVED else table(spark, sf_dir, i)
        for i in _inputs(sql)
    }
    if spread:
        inputs = {i: df.hint("rebalance") for i, df in inputs.items()}
    return spark.sql(sql, **inputs)


def derived_as_cte(name: str) -> str:
    sql = DERIVED[name]
    return f"{name} as ({sql.format(**{i: i for i in _inputs(sql)}).strip()})"


def with_dependencies(names: tuple[str, ...]) -> list[str]:
    """The named derived tables and those they read, each after what it reads."""
    order: list[str] = []
    for name in names:
        needed = with_dependencies(tuple(i for i in _inputs(DERIVED[name]) if i in DERIVED))
        order += [n for n in [*needed, name] if n not in order]
    return order
