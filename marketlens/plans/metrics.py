"""Metric, ranking and matching queries over notes, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cues as cue_ops, matching, metrics as ops
from ..sources.tables import derived, table
from . import dimensions as dim
from .registry import query

CUES = dim.CUES


def _alternatives(terms: list[str]) -> str:
    """The plain alternation, longest first: what the factored pattern must agree with."""
    return r"\b(" + "|".join(sorted(set(terms), key=lambda t: (-len(t), t))) + r")\b"


def _pattern(*groups: str) -> str:
    return _alternatives(cue_ops.terms_of(CUES, *groups))


def _count_sql(*groups: str) -> str:
    return f"len(regexp_extract_all(lower(text), '{_pattern(*groups)}', 1))"


def _scale_sql(x: str) -> str:
    return f"cast(greatest(1, least(10, 1 + floor(9 * ({x})))) as integer)"


def _amount_sql(raw: str) -> str:
    number = f"try_cast(regexp_replace({raw}, '[^0-9.]', '', 'g') as double)"
    return (
        f"{number} * case right({raw}, 1) when 'K' then 1e3 when 'M' then 1e6 when 'B' then 1e9 else 1 end"
    )


def _first_sql(pattern: str) -> str:
    return f"({_amount_sql(f'''nullif(regexp_extract(text, '{pattern}', 1), '')''')})"


def _hits_sql(cues: list, keep: str) -> str:
    pattern = _alternatives([t for _, t, _ in cues])
    values = dim.sql_values(cues, "vocabulary", "cue_group, term, weight")
    return f"""{values},
    hits as (
      select * from (
        select {keep}, unnest(regexp_extract_all(lower(text), '{pattern}', 1)) as term from notes)
      join vocabulary using (term))
    """


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "notes")


def _notes_query(name: str, sql: str):
    """Register a metric that reads only the notes."""

    def register(fn):
        query(name, sql, uses=("notes",))(lambda spark, sf_dir: fn(notes(spark, sf_dir)))
        return fn

    return register


@_notes_query(
    "money_percent_mentions",
    f"""with found as (
      select doc_id, regexp_extract_all(text, '{ops.MONEY_OR_PERCENT}') as m from notes),
    mentions as (select doc_id, unnest(m) as mention, unnest(range(len(m))) as pos from found)
    select doc_id, cast(pos as integer) as pos, mention,
      case when mention like '$%' then 'money' else 'percent' end as kind,
      {_amount_sql('mention')} as amount from mentions""",
)
def money_percent_mentions(n: DataFrame) -> DataFrame:
    return ops.money_percent_mentions(n, "doc_id", "text")


@_notes_query(
    "date_extract",
    f"""with found as (select doc_id, regexp_extract_all(text, '{ops.ISO_DATE}') as m from notes)
    select * from (
      select doc_id, try_cast(unnest(m) as date) as mentioned_on,
        cast(unnest(range(len(m))) as integer) as pos from found)
    where mentioned_on is not null""",
)
def date_extract(n: DataFrame) -> DataFrame:
    return ops.date_mentions(n, "doc_id", "text")


@_notes_query(
    "filter_recent",
    "select doc_id, ts from notes where ts >= (select max(ts) from notes) - interval 6 month",
)
def filter_recent(n: DataFrame) -> DataFrame:
    return ops.filter_recent(n.select("doc_id", "ts"), "ts", 6)


@_notes_query(
    "financial_health",
    f"""select source, round(avg({_first_sql(ops.MARGIN)}), 4) as margin,
      round(avg({_first_sql(ops.GROWTH)}), 4) as revenue_growth,
      round(sum({_first_sql(ops.INVESTMENT)}), 2) as investment
    from notes group by source""",
)
def financial_health(n: DataFrame) -> DataFrame:
    return ops.financial_health(n, "source")


@_notes_query(
    "acquisition_cost",
    f"""select force, round(sum({_first_sql(ops.SPEND)})
      / nullif(sum({_first_sql(ops.NEW_CUSTOMERS)}), 0), 4) as acquisition_cost
    from notes group by force""",
)
def acquisition_cost(n: DataFrame) -> DataFrame:
    return ops.acquisition_cost(n, "force")


@_notes_query(
    "contract_terms",
    f"""select source, count({_first_sql(ops.TERM_MONTHS)}) as mentions,
      round(avg({_first_sql(ops.TERM_MONTHS)}), 4) as mean_months,
      max({_first_sql(ops.TERM_MONTHS)}) as longest_months
    from notes group by source""",
)
def contract_terms(n: DataFrame) -> DataFrame:
    return ops.contract_terms(n, "source")


@_notes_query(
    "lead_scoring",
    f"""with sums as (
      select entity_id, sum({_count_sql('intent')})::bigint as intent,
        sum({_count_sql('engagement')})::bigint as engagement,
        coalesce(sum({_first_sql(ops.BUDGET)}), 0.0) as b
      from notes group by entity_id)
    select entity_id, intent, engagement, round(b, 2) as budget,
      round(2 * intent + engagement + log10(1 + b), 4) as lead_score from sums""",
)
def lead_scoring(n: DataFrame) -> DataFrame:
    return ops.lead_scoring(n, CUES)


def _threat_sql(groups: tuple[str, ...], by: str, name: str) -> str:
    chosen = ", ".join(f"'{g}'" for g in groups)
    return f"""with {_hits_sql(CUES, by)},
    sums as (
      select {by}, count(*) as cue_hits, sum(weight) as total,
        coalesce(sum(weight) filter (cue_group in ({chosen})), 0.0) as own
      from hits group by {by})
    select {by}, cue_hits, round(own / total, 6) as cue_share, {_scale_sql('own / total')} as {name}
    from sums"""


_SUBSTITUTION = ("price", "switching", "parity")
_ENTRY = ("regulation", "scale", "brand")


@_notes_query(
    "substitution_threat", _threat_sql(_SUBSTITUTION, "source", "substitution_threat_score")
)
def substitution_threat(n: DataFrame) -> DataFrame:
    return ops.weighted_threat(n, CUES, _SUBSTITUTION, "source", "substitution_threat_score")


@_notes_query("entry_threat", _threat_sql(_ENTRY, "source", "entry_threat_score"))
def entry_threat(n: DataFrame) -> DataFrame:
    return ops.weighted_threat(n, CUES, _ENTRY, "source", "entry_threat_score")


@_notes_query(
    "entry_dashboard",
    f"""select cast(date_trunc('month', ts) as date) as month,
      sum({_count_sql('license')})::bigint as licenses,
      round(coalesce(sum({_first_sql(ops.INVESTMENT)}), 0.0), 2) as capital_inflow,
      sum({_count_sql('patent')})::bigint as patents
    from notes group by 1""",
)
def entry_dashboard(n: DataFrame) -> DataFrame:
    return ops.entry_dashboard(n, CUES)


_DISRUPTION = ("adoption", "regulation", "behaviour")


@_notes_query(
    "disruption_cues",
    f"""with {_hits_sql([c for c in CUES if c[0] in _DISRUPTION], 'ts')}
    select cue_group, cast(date_trunc('month', ts) as date) as month, count(*) as mentions
    from hits group by 1, 2""",
)
def disruption_cues(n: DataFrame) -> DataFrame:
    return ops.cue_timeline(n, CUES, _DISRUPTION)


@_notes_query(
    "entrant_profile",
    f"""with terms as (
      select ts, list_distinct(regexp_extract_all(lower(text), '{_pattern('entrant')}', 1)) as e,
        list_distinct(regexp_extract_all(lower(text), '{_pattern('entry_vector')}', 1)) as v
      from notes),
    entrants as (select ts, unnest(e) as entrant, v from terms),
    entries as (select ts, entrant, unnest(v) as entry_vector from entrants)
    select entrant, entry_vector, count(*) as notes, cast(min(ts) as date) as first_seen
    from entries group by 1, 2""",
)
def entrant_profile(n: DataFrame) -> DataFrame:
    return ops.entrant_profile(n, CUES)


@_notes_query(
    "sentiment_by_source",
    f"""with {_hits_sql([('sentiment', t, p) for t, p in dim.LEXICON], 'source, force')}
    select source, force, count(*) as opinions, round(avg(weight), 6) as sentiment
    from hits group by 1, 2""",
)
def sentiment_by_source(n: DataFrame) -> DataFrame:
    return ops.sentiment_by_source(n, dim.LEXICON)


@_notes_query(
    "observation_confidence",
    f"""with {_hits_sql([('any', t, 1.0) for t in sorted({c[1] for c in CUES})], 'source')}
    select term, count(*) as mentions,
      round(count(distinct source) / (select count(distinct source) from notes), 6) as confidence
    from hits group by term""",
)
def observation_confidence(n: DataFrame) -> DataFrame:
    return ops.observation_confidence(n, CUES)


@_notes_query(
    "merge_forces",
    f"""with {_hits_sql(CUES, 'doc_id')},
    weights as (select doc_id, sum(weight) as w from hits group by doc_id),
    scores as (
      select source, force, round(avg(coalesce(w, 0.0)), 6) as score
      from notes left join weights using (doc_id) group by 1, 2)
    select source, {", ".join(f"max(score) filter (force = '{f}') as {f}" for f in dim.CANONICAL_FORCES)}
    from scores group by source""",
)
def merge_forces(n: DataFrame) -> DataFrame:
    return ops.merge_forces(ops.force_scores(n, CUES, "source"), "source", dim.CANONICAL_FORCES)


@_notes_query(
    "dashboard_rollup",
    """with flat as (select force, source, cast(year(ts) as integer) as year, amount from notes)
    select force, source, year, cast(grouping(force, source, year) as integer) as level,
      count(*) as notes, round(sum(amount), 2) as amount
    from flat group by rollup (force, source, year)""",
)
def dashboard_rollup(n: DataFrame) -> DataFrame:
    return ops.dashboard_rollup(n)


@query(
    "report_structure",
    f"""with {dim.sql_values([(f, s, i) for f, names in dim.SECTIONS.items() for i, s in enumerate(names)],
      'sections', 'force, section, ix')},
    checked as (
      select report_id, force, section, ix, contains(lower(text), lower(section)) as present
      from reports join sections using (force))
    select report_id, force, count(*)::integer as required,
      cast(count(*) filter (present) as integer) as present,
      coalesce(string_agg(section, '|' order by ix) filter (not present), '') as missing
    from checked group by report_id, force""",
    uses=("reports",),
)
def report_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.report_structure(derived(spark, sf_dir, "reports"), dim.SECTIONS)


@query(
    "rivalry_concentration",
    f"""with sales as (
      select p_type as market, l_suppkey as competitor, year(l_shipdate) as year,
        l_extendedprice * (1 - l_discount) as revenue
      from lineitem join part on p_partkey = l_partkey),
    newest as (select max(year(l_shipdate)) as y from lineitem),
    competitors as (
      select market, competitor, sum(revenue) as r, sum(revenue) filter (year = y) as last,
        sum(revenue) filter (year = y - 1) as before
      from sales cross join newest group by 1, 2),
    markets as (
      select market, count(*) as competitors, sum(r * r) / (sum(r) * sum(r)) as h,
        sum(last) / sum(before) - 1 as g
      from competitors group by market)
    select market, competitors, round(h, 6) as hhi, round(g, 4) as growth,
      {_scale_sql('h')} as concentration_score from markets""",
)
def rivalry_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    sales = lines.select(
        "l_partkey",
        F.col("l_suppkey").alias("competitor"),
        F.year("l_shipdate").alias("year"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )
    newest = lines.select(F.year(F.max("l_shipdate"))).scalar()
    per_part = ops.revenue_by(sales, ["l_partkey", "competitor"], newest)
    markets = parts.select("p_partkey", F.col("p_type").alias("market"))
    return ops.rivalry_concentration(per_part.join(markets, F.col("l_partkey") == F.col("p_partkey")))


@query(
    "buyer_concentration",
    f"""with per_customer as (
      select entity_id, sum(amount) as spend, sum({_count_sql('switching')}) as s,
        sum({_count_sql('price')}) as p
      from notes group by entity_id)
    select c_mktsegment as segment, count(*) as customers,
      round(max(spend) / sum(spend), 6) as top_share, sum(s)::bigint as switching_cues,
      sum(p)::bigint as price_cues, {_scale_sql('max(spend) / sum(spend)')} as concentration_score
    from per_customer join customer on c_custkey = entity_id group by 1""",
    uses=("notes",),
)
def buyer_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.buyer_concentration(
        notes(spark, sf_dir), table(spark, sf_dir, "customer"), CUES
    )


@query(
    "supplier_criticality",
    f"""with said as (
      select l_partkey, sum({_count_sql('switching')})::bigint as switching_cues,
        sum({_count_sql('unique_technology')})::bigint as unique_dependencies
      from lineitem join notes on doc_id = l_orderkey group by l_partkey)
    select l_partkey, count(distinct l_suppkey) as alternatives,
      {_scale_sql('1.0::double / count(distinct l_suppkey)')} as criticality_score,
      coalesce(any_value(switching_cues), 0) as switching_cues,
      coalesce(any_value(unique_dependencies), 0) as unique_dependencies
    from lineitem left join said using (l_partkey) group by l_partkey""",
    uses=("notes",),
)
def supplier_criticality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.supplier_criticality(table(spark, sf_dir, "lineitem"), notes(spark, sf_dir), CUES)


@query(
    "cost_volatility",
    f"""with said as (
      select l_partkey, count(cost) as stated, round(avg(cost), 4) as stated_unit_cost
      from lineitem join (select doc_id, {_first_sql(ops.UNIT_COST)} as cost from notes) on doc_id = l_orderkey
      group by l_partkey)
    select l_partkey, round(avg(l_extendedprice / l_quantity), 4) as mean_unit_cost,
      round(stddev_samp(l_extendedprice / l_quantity) / avg(l_extendedprice / l_quantity), 4) as volatility,
      coalesce(any_value(stated), 0) as stated, any_value(stated_unit_cost) as stated_unit_cost
    from lineitem left join said using (l_partkey) group by l_partkey""",
    uses=("notes",),
)
def cost_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cost_volatility(table(spark, sf_dir, "lineitem"), notes(spark, sf_dir))


@query(
    "supplier_risk",
    """with single as (
      select l_partkey, date_trunc('quarter', l_shipdate) as quarter, min(l_suppkey) as l_suppkey
      from lineitem group by 1, 2 having count(distinct l_suppkey) = 1)
    select l_suppkey, count(*) as single_source_quarters, cast(min(quarter) as date) as first_quarter
    from single group by l_suppkey""",
)
def supplier_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.supplier_risk(table(spark, sf_dir, "lineitem"))


_THREATS = ("alternative", "parity", "price", "adoption", "behaviour")


@query(
    "threat_matrix",
    f"""with {_hits_sql([c for c in CUES if c[0] in _THREATS], 'entity_id, ts')},
    newest as (select year(max(ts)) as y from notes),
    aged as (
      select hits.*, y - year(ts) as age, cue_group in ('behaviour', 'adoption') as changed
      from hits cross join newest)
    select c_mktsegment as industry,
      {", ".join(f"count(*) filter (cue_group = '{g}') as {g}" for g in _THREATS)},
      round(count(*) filter (cue_group = 'alternative' and age = 0)
        / nullif(count(*) filter (cue_group = 'alternative' and age = 1), 0) - 1, 4) as alternative_growth,
      round(count(*) filter (changed and age = 0) / nullif(count(*) filter (age = 0), 0)
        - count(*) filter (changed and age = 1) / nullif(count(*) filter (age = 1), 0), 4) as preference_shift
    from aged join customer on c_custkey = entity_id group by 1""",
    uses=("notes",),
)
def threat_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.threat_matrix(
        notes(spark, sf_dir), table(spark, sf_dir, "customer"), CUES, _THREATS
    )


@query(
    "top10_entities",
    f"""with {_hits_sql(CUES, 'entity_id')},
    best as (
      select entity_id, sum(weight) as relevance,
        round(sum(weight) / (sum(weight) + 5), 4) as confidence,
        string_agg(distinct cue_group, ', ' order by cue_group) as tags
      from hits group by entity_id order by relevance desc, entity_id limit 10)
    select entity_id, c_name as title, c_mktsegment as summary, tags, relevance, confidence
    from best join customer on c_custkey = entity_id""",
    uses=("notes",),
)
def top10_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_entities(notes(spark, sf_dir), table(spark, sf_dir, "customer"), CUES)


@query(
    "trend_velocity",
    """with daily as (
      select event_type, cast(date_trunc('day', ts) as date) as day, count(*) as mentions
      from events group by 1, 2),
    strongest as (
      select event_type, sum(mentions)::bigint as total from daily group by 1
      order by total desc, event_type limit 3)
    select event_type, day, mentions, total,
      case when lag(day) over w is not null then mentions
        - case when lag(day) over w + 1 = day then lag(mentions) over w else 0 end end as velocity
    from daily join strongest using (event_type)
    window w as (partition by event_type order by day)""",
)
def trend_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.trend_velocity(table(spark, sf_dir, "events"))


@query(
    "fuzzy_match",
    """with l as (
      select lower(trim(company_name)) as left_name, count(*) as left_records
      from internal_companies group by 1),
    r as (
      select lower(trim(company_name)) as right_name, count(*) as right_records
      from external_companies group by 1)
    select *, round(1 - edits::double / greatest(length(left_name), length(right_name), 1), 6) as score
    from (select *, cast(levenshtein(left_name, right_name) as integer) as edits
      from l join r on abs(length(left_name) - length(right_name)) <= 1)
    where edits <= 1""",
    uses=("internal_companies", "external_companies"),
)
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.fuzzy_match(
        derived(spark, sf_dir, "internal_companies"),
        derived(spark, sf_dir, "external_companies"),
        "company_name",
        "company_name",
    )


@query(
    "fuse_internal_external",
    """select coalesce(lower(i.company_name), lower(e.company_name)) as fused_key,
      company_id, external_id, coalesce(i.company_name, e.company_name) as company_name,
      coalesce(i.segment, e.segment) as segment
    from internal_companies i full outer join external_companies e
      on lower(i.company_name) = lower(e.company_name)""",
    uses=("internal_companies", "external_companies"),
)
def fuse_internal_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.fuse(
        derived(spark, sf_dir, "internal_companies"),
        derived(spark, sf_dir, "external_companies"),
        F.lower("company_name"),
        ("company_id", "external_id"),
        ["company_name", "segment"],
    )


@query(
    "ungrounded_numbers",
    f"""with stated as (
      select distinct report_id, entity_id, unnest(regexp_extract_all(text, '{ops.MONEY_OR_PERCENT}')) as figure
      from reports),
    known as (
      select distinct entity_id, unnest(regexp_extract_all(text, '{ops.MONEY_OR_PERCENT}')) as figure
      from notes)
    select * from stated anti join known using (entity_id, figure)""",
    uses=("reports", "notes"),
)
def ungrounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ungrounded_numbers(
        derived(spark, sf_dir, "reports"), notes(spark, sf_dir)
    )


_VALUE_SQL = """round(cast(regexp_replace(figure, '[^0-9.]', '', 'g') as double) * case right(figure, 1)
      when 'K' then 1e3 when 'M' then 1e6 when 'B' then 1e9 else 1 end, 4) as value, starts_with(figure, '$') as money"""


@query(
    "ungrounded_values",
    f"""with stated as (
      select *, {_VALUE_SQL} from (
        select distinct report_id, entity_id, unnest(regexp_extract_all(text, '{ops.MONEY_OR_PERCENT}')) as figure
        from reports)),
    known as (
      select distinct entity_id, {_VALUE_SQL} from (
        select entity_id, unnest(regexp_extract_all(text, '{ops.MONEY_OR_PERCENT}')) as figure from notes))
    select report_id, entity_id, figure from stated anti join known using (entity_id, value, money)""",
    uses=("reports", "notes"),
)
def ungrounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ungrounded_numbers(
        derived(spark, sf_dir, "reports"), notes(spark, sf_dir), by_value=True
    )
