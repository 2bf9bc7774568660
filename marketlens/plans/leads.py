"""Lead queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import leads as ops
from ..sources.tables import derived, table
from . import sql_text as q
from .dimensions import local_table
from .registry import query


def raw_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw leads with the nested address the feed has."""
    flat = derived(spark, sf_dir, "raw_leads")
    return flat.withColumn("address", F.struct(*ops.ADDRESS_FIELDS)).drop(*ops.ADDRESS_FIELDS)


def flat_address(leads: DataFrame) -> DataFrame:
    return leads.select("*", "address.*").drop("address")


def _scalar(name: str, column: str, fn, sql: str):
    """Register a one-column function over all raw leads."""

    @query(
        name,
        f"select ordinal, {sql} as {column} from raw_leads",
        uses=("raw_leads",),
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derived(spark, sf_dir, "raw_leads").select("ordinal", fn(column).alias(column))


_scalar("clean_str", "full_name", text.clean_str, q.clean_str("full_name"))
_scalar("normalize_email", "email", text.normalize_email, q.email("email"))
_scalar("normalize_phone", "phone", text.normalize_phone, q.phone("phone"))
_scalar("normalize_url", "website_url", text.normalize_url, q.url("website_url"))

CLEAN_SQL = f"""
cleaned as (
  select source_file, ordinal,
    sha256(source_file || '|' || cast(ordinal as varchar)) as id,
    {q.clean_str('full_name')} as full_name, {q.email('email')} as email,
    {q.phone('phone')} as phone, {q.clean_str('company')} as company,
    {q.clean_str('job_title')} as job_title, {q.clean_str('street')} as street,
    {q.clean_str('city')} as city, {q.clean_str('postal_code')} as postal_code,
    {q.clean_str('country')} as country, {q.url('linkedin_url')} as linkedin_url,
    {q.url('website_url')} as website_url, {q.clean_str('industry')} as industry0,
    {q.clean_str('company_size')} as size0, coalesce(source, 'Unknown') as source
  from raw_leads),
clean as (
  select * exclude (industry0, size0),
    {q.first_name('full_name')} as first_name, {q.last_name('full_name')} as last_name,
    {q.enriched('company', 'IT & Software', 'Innovation & Technology', 'industry0')} as industry,
    {q.enriched('company', '51-200 employees', '11-50 employees', 'size0')} as company_size
  from cleaned)
"""

DEDUPED_SQL = f"""{CLEAN_SQL},
deduped as (
  select * from clean
  qualify row_number() over (
    partition by source_file, coalesce(lower(email), 'none') order by ordinal) = 1)
"""


@query(
    "split_name",
    f"with {CLEAN_SQL} select ordinal, full_name, first_name, last_name from clean",
    uses=("raw_leads",),
)
def split_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = derived(spark, sf_dir, "raw_leads").select(
        "ordinal", text.clean_str("full_name").alias("full_name")
    )
    return cleaned.select(
        "*",
        text.first_name("full_name").alias("first_name"),
        text.last_name("full_name").alias("last_name"),
    )


@query(
    "enrich_company",
    f"with {CLEAN_SQL} select ordinal, company, industry, company_size from clean",
    uses=("raw_leads",),
)
def enrich_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        derived(spark, sf_dir, "raw_leads")
        .withColumn("company", text.clean_str("company"))
        .select(
            "ordinal",
            "company",
            text.enriched_industry("company", text.clean_str("industry")).alias("industry"),
            text.enriched_company_size("company", text.clean_str("company_size")).alias(
                "company_size"
            ),
        )
    )


@query(
    "address_struct",
    f"with {CLEAN_SQL} select ordinal, street, city, postal_code, country from clean",
    uses=("raw_leads",),
)
def address_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = ops.clean_leads(raw_leads(spark, sf_dir), timestamp=False)
    return cleaned.select("ordinal", "address.*")


@query(
    "lead_defaults",
    f"with {CLEAN_SQL} select ordinal, id, source from clean",
    uses=("raw_leads",),
)
def lead_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clean_leads(raw_leads(spark, sf_dir), timestamp=False).select(
        "ordinal", "id", "source"
    )


@query("clean_leads", f"with {CLEAN_SQL} select * from clean", uses=("raw_leads",))
def clean_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_address(ops.clean_leads(raw_leads(spark, sf_dir), timestamp=False))


@query("dedupe_leads", f"with {DEDUPED_SQL} select * from deduped", uses=("raw_leads",))
def dedupe_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = ops.clean_leads(raw_leads(spark, sf_dir), timestamp=False)
    return flat_address(ops.dedupe_leads(cleaned))


@query(
    "filter_nonempty_key",
    f"with {CLEAN_SQL} select ordinal, coalesce(lower(website_url), '') as dedupe_key from clean"
    " where coalesce(lower(website_url), '') <> ''",
    uses=("raw_leads",),
)
def filter_nonempty_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = ops.clean_leads(raw_leads(spark, sf_dir), timestamp=False).select(
        "ordinal", F.coalesce(F.lower("website_url"), F.lit("")).alias("dedupe_key")
    )
    return ops.filter_nonempty_key(keyed, F.col("dedupe_key"))


# Surface forms beside the place names of the given tables.
KNOWN_ENTITIES = (("Acme Tech", "ORG"), ("Blue Startup", "ORG"), ("VP Sales", "TITLE"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_name", F.lit("GPE"))
    regions = table(spark, sf_dir, "region").select("r_name", F.lit("GPE"))
    known = local_table(spark, "surface label", KNOWN_ENTITIES)
    return known.union(nations).union(regions)


ENTITY_HITS_SQL = f"""
    gazetteer as (
      select n_name as surface, 'GPE' as label from nation
      union select r_name, 'GPE' from region
      union values ('Acme Tech', 'ORG'), ('Blue Startup', 'ORG'), ('VP Sales', 'TITLE')),
    words as (select ordinal, regexp_extract_all(job_title, '[\\p{{L}}\\p{{N}}_]+') as t from clean),
    starts as (select ordinal, t, unnest(range(1, len(t) + 1)) as pos from words),
    grams as (
      select ordinal, pos, n, array_to_string(t[pos:pos + n - 1], ' ') as surface
      from starts, (values (1), (2), (3)) as sizes(n) where pos + n - 1 <= len(t)),
    hits as (select * from grams join gazetteer using (surface))
"""


@query(
    "entity_tag",
    f"""with {CLEAN_SQL}, {ENTITY_HITS_SQL}
    select ordinal,
      coalesce(string_agg(surface, '|' order by pos, n) filter (label = 'PERSON'), '') as persons,
      coalesce(string_agg(surface, '|' order by pos, n) filter (label = 'ORG'), '') as organizations,
      coalesce(string_agg(surface, '|' order by pos, n) filter (label = 'GPE'), '') as locations,
      coalesce(string_agg(surface || '/' || label, '|' order by pos, n)
        filter (label not in ('PERSON', 'ORG', 'GPE')), '') as misc
    from hits group by ordinal""",
    uses=("raw_leads",),
)
def entity_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = derived(spark, sf_dir, "raw_leads").select(
        "ordinal", text.clean_str("job_title").alias("job_title")
    )
    tagged = ops.tag_entities(titles, "job_title", gazetteer(spark, sf_dir), "ordinal")
    misc = F.transform("misc", lambda m: F.concat_ws("/", m["text"], m["label"]))
    return tagged.select(
        "ordinal",
        F.array_join("persons", "|").alias("persons"),
        F.array_join("organizations", "|").alias("organizations"),
        F.array_join("locations", "|").alias("locations"),
        F.array_join(misc, "|").alias("misc"),
    )


@query(
    "leads_with_entities",
    f"""with {CLEAN_SQL}, {ENTITY_HITS_SQL},
    counts as (
      select ordinal, count(*) filter (label = 'ORG') as orgs,
        count(*) filter (label = 'GPE') as places, count(*) as found
      from hits group by ordinal)
    select ordinal, job_title is not null as has_entities,
      case when job_title is not null then coalesce(orgs, 0) end::integer as organizations,
      case when job_title is not null then coalesce(places, 0) end::integer as locations,
      case when job_title is not null then coalesce(found - orgs - places, 0) end::integer as others
    from clean left join counts using (ordinal)""",
    uses=("raw_leads",),
)
def leads_with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = ops.clean_leads(raw_leads(spark, sf_dir), timestamp=False)
    leads = ops.attach_entities(cleaned, gazetteer(spark, sf_dir))
    n = {c: F.when(F.col("entities").isNotNull(), F.size(f"entities.{c}")) for c in (
        "persons", "organizations", "locations", "misc"
    )}
    return leads.select(
        "ordinal",
        F.col("entities").isNotNull().alias("has_entities"),
        n["organizations"].alias("organizations"),
        n["locations"].alias("locations"),
        (n["persons"] + n["misc"]).alias("others"),
    )


@query(
    "dedupe_content",
    f"""select sha256(lower(trim(regexp_replace(text, '{q.WS}+', ' ', 'g')))) as content_hash,
      min(doc_id) as doc_id, count(*) as copies from documents group by 1""",
)
def dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedupe_content(table(spark, sf_dir, "documents"), "text", "doc_id")
