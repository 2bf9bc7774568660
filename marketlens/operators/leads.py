"""Lead records: cleaning, keep-first deduplication, entity tagging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text

_STRING = T.StringType()
ADDRESS_FIELDS = ("street", "city", "postal_code", "country")
LEAD_SCHEMA = T.StructType(
    [
        T.StructField(name, _STRING)
        for name in ("full_name", "email", "phone", "company", "job_title")
    ]
    + [T.StructField("address", T.StructType([T.StructField(f, _STRING) for f in ADDRESS_FIELDS]))]
    + [
        T.StructField(name, _STRING)
        for name in ("linkedin_url", "website_url", "industry", "company_size", "source")
    ]
)

# What the key of a missing value looks like: the text of an absent value, lower-cased.
NULL_KEY = "none"

# As many first words of names as are broadcast.
FIRST_WORDS = 200_000


def clean_leads(leads: DataFrame, *, timestamp: bool = True) -> DataFrame:
    """Clean and enrich lead rows in one narrow projection.

    ``leads`` carries ``LEAD_SCHEMA`` plus ``source_file`` and ``ordinal``, which
    give each lead its place and its stable id.
    """
    cleaned = leads.select(
        "source_file",
        "ordinal",
        F.sha2(F.concat_ws("|", "source_file", F.col("ordinal").cast("string")), 256).alias("id"),
        text.clean_str("full_name").alias("full_name"),
        text.normalize_email("email").alias("email"),
        text.normalize_phone("phone").alias("phone"),
        text.clean_str("company").alias("company"),
        text.clean_str("job_title").alias("job_title"),
        F.struct(*[text.clean_str(f"address.{f}").alias(f) for f in ADDRESS_FIELDS]).alias(
            "address"
        ),
        text.normalize_url("linkedin_url").alias("linkedin_url"),
        text.normalize_url("website_url").alias("website_url"),
        text.clean_str("industry").alias("industry"),
        text.clean_str("company_size").alias("company_size"),
        F.coalesce("source", F.lit(text.UNKNOWN_SOURCE)).alias("source"),
    )
    enriched = cleaned.withColumns(
        {
            "first_name": text.first_name("full_name"),
            "last_name": text.last_name("full_name"),
            "industry": text.enriched_industry("company", "industry"),
            "company_size": text.enriched_company_size("company", "company_size"),
        }
    )
    return enriched.withColumn("last_updated", F.current_timestamp()) if timestamp else enriched


def dedupe_key(fields: Sequence[str], *, null_key: str = "collapse", composite: str = "joined") -> Column:
    """Lower-cased key over ``fields``.

    ``null_key='collapse'`` gives all missing values one shared key;
    ``'keep'`` makes the key NULL when every field is missing.
    ``composite='struct'`` keeps fields apart, so ``(a_b, c)`` and ``(a, b_c)`` differ.
    """
    parts = [F.coalesce(F.lower(F.col(f).cast("string")), F.lit(NULL_KEY)) for f in fields]
    key = F.concat_ws("_", *parts) if composite == "joined" else F.to_json(F.array(*parts))
    if null_key == "collapse":
        return key
    present = F.coalesce(*[F.col(f).cast("string") for f in fields])
    return F.when(present.isNotNull(), key)


def filter_nonempty_key(df: DataFrame, key: Column) -> DataFrame:
    return df.filter(key != "")


def dedupe_leads(
    leads: DataFrame,
    fields: Sequence[str] = ("email",),
    *,
    scope: Sequence[str] = ("source_file",),
    order: Sequence[str] = ("ordinal",),
    null_key: str = "collapse",
    composite: str = "joined",
) -> DataFrame:
    """Keep the first row per key within ``scope``.

    Each task cuts every key to one row before the exchange (a window group
    limit), so one key shared by a third of all rows costs one row per task.
    """
    key = dedupe_key(fields, null_key=null_key, composite=composite)
    keyed = leads.withColumn("_key", key)
    if null_key == "keep":
        # A keyless row is its own group; the ids spread them evenly.
        own = F.concat(F.lit("\x00"), F.to_json(F.struct(*scope, *order)))
        keyed = keyed.withColumn("_key", F.coalesce("_key", own))
    rank = F.row_number().over(Window.partitionBy(*scope, "_key").orderBy(*order))
    return (
        filter_nonempty_key(keyed, F.col("_key"))
        .withColumn("_rank", rank)
        .filter("_rank = 1")
        .drop("_key", "_rank")
    )


def entity_tokens(c: Column | str) -> Column:
    source = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(source, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def name_candidates(
    rows: DataFrame, text_column: str, names: DataFrame, id_column: str, first_words: int = FIRST_WORDS
) -> DataFrame:
    """Spans of a text that may be a name: those that begin as a name of their length does.

    ``names`` holds the words of each name in ``_t``. A span is cut only where its first word begins
    a name, and only in the lengths of the names that begin so; a long name costs nothing where
    its first word is absent. Up to ``first_words`` first words (counted) are broadcast and texts stay in place.
    Beyond, words meet them by a join, and only the places found go back to their texts.
    """
    first = F.get("_t", F.lit(0)).alias("_first")
    firsts = names.groupBy(first).agg(F.array_sort(F.collect_set(F.size("_t"))).alias("_lengths"))
    words = rows.select(id_column, entity_tokens(text_column).alias("_t"))
    if firsts.limit(first_words + 1).count() <= first_words:
        starts = words.select("*", F.posexplode("_t").alias("pos", "_first")).join(
            F.broadcast(firsts), "_first"
        )
    else:
        places = (
            words.select(id_column, F.posexplode("_t").alias("pos", "_first"))
            .join(firsts, "_first")
            .groupBy(id_column)
            .agg(F.collect_list(F.struct("pos", "_lengths")).alias("_places"))
        )
        starts = words.join(places, id_column).select(id_column, "_t", F.inline("_places"))
    return starts.select(
        id_column,
        F.inline(
            F.transform(
                F.filter("_lengths", lambda n: n <= F.size("_t") - F.col("pos")),
                lambda n: F.struct(
                    F.col("pos"),
                    n.alias("words"),
                    F.array_join(F.slice("_t", F.col("pos") + 1, n), " ").alias("surface"),
                ),
            )
        ),
    )


def tag_entities(
    rows: DataFrame,
    text_column: str,
    gazetteer: DataFrame,
    id_column: str,
    *,
    first_words: int = FIRST_WORDS,
) -> DataFrame:
    """Gazetteer matches grouped as persons, organizations, locations and misc.

    Names may have any length. Where matches overlap, the longest counts, then the first;
    a name with several labels counts for each.

    ``gazetteer(surface, label)`` is joined on the surface form; Spark broadcasts
    it while it is under the threshold and sort-merges it when it is not. Only
    matches reach the grouping exchange. One sorted pass cuts a text's matches into runs that
    overlap; matches are compared within a run only.
    """
    names = gazetteer.select(entity_tokens("surface").alias("_t"), "label").filter(F.size("_t") > 0)
    found = name_candidates(rows, text_column, names, id_column, first_words).join(
        names.select(F.array_join("_t", " ").alias("surface"), "label").distinct(), "surface"
    )

    by_place = Window.partitionBy(id_column).orderBy("pos")
    reached = F.max(F.col("pos") + F.col("words")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reached.isNull() | (F.col("pos") >= reached)).cast("int")
    runs = (
        found.withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(id_column, "_run")
        .agg(
            F.sort_array(
                F.collect_list(F.struct((-F.col("words")).alias("less"), "pos", "words", "surface", "label"))
            ).alias("_s")
        )
    )

    def apart(x: Column, y: Column) -> Column:
        same = (x["pos"] == y["pos"]) & (x["words"] == y["words"])
        return same | (x["pos"] + x["words"] <= y["pos"]) | (y["pos"] + y["words"] <= x["pos"])

    span = "struct<less:int,pos:int,words:int,surface:string,label:string>"
    disjoint = F.aggregate(
        "_s",
        F.array().cast(f"array<{span}>"),
        lambda acc, x: F.when(F.forall(acc, lambda y: apart(x, y)), F.concat(acc, F.array(x))).otherwise(acc),
    )
    kept = F.transform(disjoint, lambda x: F.struct(x["pos"].alias("pos"), x["surface"].alias("surface"), x["label"].alias("label")))
    tagged = runs.groupBy(id_column).agg(F.sort_array(F.flatten(F.collect_list(kept))).alias("_s"))

    def of(label: str) -> Column:
        return F.transform(F.filter("_s", lambda x: x["label"] == label), lambda x: x["surface"])

    return tagged.select(
        id_column,
        of("PERSON").alias("persons"),
        of("ORG").alias("organizations"),
        of("GPE").alias("locations"),
        F.transform(
            F.filter("_s", lambda x: ~x["label"].isin("PERSON", "ORG", "GPE")),
            lambda x: F.struct(x["surface"].alias("text"), x["label"].alias("label")),
        ).alias("misc"),
    )


def attach_entities(leads: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Cleaned leads with ``entities``: NULL without a job title, empty lists without a match."""
    tagged = tag_entities(leads, "job_title", gazetteer, "id")
    lists = ("persons", "organizations", "locations", "misc")
    kinds = {c: tagged.schema[c].dataType for c in lists}
    entities = F.struct(
        *[F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c) for c in lists]
    )
    return (
        leads.join(tagged, "id", "left")
        .withColumn("entities", F.when(F.col("job_title").isNotNull(), entities))
        .drop(*lists)
    )


def dedupe_content(docs: DataFrame, text_column: str, id_column: str) -> DataFrame:
    """One kept id per distinct content, with the number of copies.

    Only digests and ids are exchanged, after a map-side combine; the text stays
    where it was read.
    """
    normalised = F.lower(F.trim(F.regexp_replace(text_column, f"{text.WS}+", " ")))
    return (
        docs.select(id_column, F.sha2(normalised, 256).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.min(id_column).alias(id_column), F.count("*").alias("copies"))
    )
